"""File sightings, download ledgers and collection checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.paths import last_segment
from plotweave.plans.ordered import ordered_lag, ordered_row_number, time_segment
from plotweave.plans.skew import salted_join
from plotweave.schemas import CORNER_COLUMNS

# Endings of downloads still in progress.
INCOMPLETE = r"\.(crdownload|tmp|part)$"
MAX_ATTEMPTS = 2
MIN_BYTES = 1000


def incomplete_files(files: DataFrame) -> DataFrame:
    """Finished files only: no partial downloads, no dot files, no folder placeholders."""
    path = F.col("path")
    partial = path.rlike(INCOMPLETE) | F.startswith(last_segment(path), F.lit(".")) | F.endswith(path, F.lit("/"))
    return files.where(~partial)


def modified_since(files: DataFrame, since: Column, pattern: str) -> DataFrame:
    """Files newer than the start of the run whose name matches."""
    return files.where((F.col("mtime") > since) & F.col("path").rlike(pattern))


def latest_file(files: DataFrame, by: str) -> DataFrame:
    """Newest file per group; of equally new ones the greatest path."""
    newest = F.max_by(F.struct("path", "size", "mtime"), F.struct("mtime", "path")).alias("_file")
    return files.groupBy(by).agg(newest).select(by, "_file.path", "_file.size", "_file.mtime")


def size_stable(sightings: DataFrame, tie: str | None = None) -> DataFrame:
    """Sightings with ``stable``: a size above zero that equals the size at the previous look."""
    order = ["seen_at"] + ([tie] if tie else [])
    looked = ordered_lag(sightings, "size", ["path"], order, time_segment("seen_at"), name="_before")
    stable = F.coalesce((F.col("size") > 0) & (F.col("size") == F.col("_before")), F.lit(False))
    return looked.withColumn("stable", stable).drop("_before")


def attempt_number(ledger: DataFrame, tie: str | None = None) -> DataFrame:
    """Attempts numbered per section; a failed second attempt is final."""
    order = ["ts"] + ([tie] if tie else [])
    numbered = ordered_row_number(ledger, order, time_segment("ts"), ["section_id"], name="attempt")
    final = (F.col("status") == "failed") & (F.col("attempt") >= MAX_ATTEMPTS)
    return numbered.withColumn("final_failure", final)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Sections in total and downloaded, failures at the first try, and sections that never came."""
    per_section = ledger.groupBy("section_id").agg(
        F.bool_or(F.col("status") != "failed").alias("_done"),
        F.min_by("status", F.struct("ts", "event_id")).alias("_first"),
    )
    return per_section.agg(
        F.count("*").alias("total"),
        F.count_if("_done").alias("downloaded"),
        F.count_if(F.col("_first") == "failed").alias("initial_failures"),
        F.count_if(~F.col("_done")).alias("still_failed"),
    )


def collection_validate(results: DataFrame, files: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rules per collection result (``key, success, files``) against the file inventory (``path, size``).

    One row per result and rule. Files are checked one by one through a join, then folded per result.
    """
    listed = results.select("key", F.explode_outer("files").alias("path"))
    checked = salted_join(listed, files.select("path", "size"), ["path"], ["key"], how="left").groupBy("key").agg(
        F.count("path").alias("_files"),
        F.count_if(F.col("path").isNotNull() & F.col("size").isNull()).alias("_missing"),
        F.count_if(F.col("size") < min_bytes).alias("_small"),
    )
    rules = F.array(
        F.struct(F.lit("success").alias("rule"), F.coalesce("success", F.lit(False)).alias("passed")),
        F.struct(F.lit("has_files").alias("rule"), (F.col("_files") > 0).alias("passed")),
        F.struct(F.lit("files_exist").alias("rule"), (F.col("_missing") == 0).alias("passed")),
        F.struct(F.lit("files_large_enough").alias("rule"), (F.col("_small") == 0).alias("passed")),
    )
    return results.select("key", "success").join(checked, "key").select("key", F.inline(rules))


def unique_hash_check(labels: DataFrame) -> DataFrame:
    """Rules of the label table: hash present and unique, all corners present.

    Counting per hash combines before the shuffle; the second count is over one row per hash.
    """
    no_corner = F.lit(False)
    for column in CORNER_COLUMNS:
        no_corner = no_corner | F.col(column).isNull()
    per_hash = labels.groupBy("pdf_hash").agg(F.count("*").alias("_n"), F.count_if(no_corner).alias("_gaps"))
    totals = per_hash.agg(
        F.count_if(F.col("pdf_hash").isNull()).alias("_nulls"),
        F.count_if(F.col("pdf_hash").isNotNull() & (F.col("_n") > 1)).alias("_repeated"),
        F.coalesce(F.sum("_gaps"), F.lit(0)).alias("_gaps"),
    )
    rule = lambda name, n: F.struct(
        F.lit("labels").alias("key"), F.lit(name).alias("rule"), (F.col(n) == 0).alias("passed"),
        F.col(n).cast("bigint").alias("violations"),
    )
    return totals.select(F.inline(F.array(
        rule("hash_present", "_nulls"), rule("hash_unique", "_repeated"), rule("corners_present", "_gaps")
    )))

"""Quality rules of a document and cross-document line frequency within hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import SPACES, staged, text_of, words_of
from plotweave.plans.once import with_once

#: A line is boilerplate of a host when more than this many of its different documents have it ...
LIMIT_DOCS = 10
#: ... and more than this many in a thousand of them.
LIMIT_PER_MILLE = 5
#: A document is depleted when less than this percentage of its words is left without boilerplate lines.
LEAST_LEFT_PERCENT = 30
#: Over how many tasks the occurrences of one line are dealt when they are looked up.
LINE_SALTS = 32


def repeated_words(hashes: str) -> list[tuple[str, Column]]:
    """Steps (name, column) that count words in 3-word windows found twice or more; the last is the count.

    Windows are sorted with their positions, so that equal ones are neighbours: n log n for any text.
    """
    windows = F.when(F.size(hashes) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 2),
        lambda i: F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1), F.element_at(hashes, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))
    ordered = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    again = F.filter("_ordered", lambda x, j: (x["h"] == F.get(F.col("_ordered"), j - 1)["h"]) | (x["h"] == F.get(F.col("_ordered"), j + 1)["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, n: total + n,
    )
    return [("_windows", windows), ("_ordered", ordered), ("_places", places), ("n_repeat_words", covered.cast("bigint"))]


def normal_lines(text: Column) -> Column:
    """Lines with a word: lower case, digits as 0, runs of spaces as one."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text_of(text)), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                 limit_docs: int = LIMIT_DOCS, limit_per_mille: int = LIMIT_PER_MILLE,
                 least_left_percent: int = LEAST_LEFT_PERCENT) -> DataFrame:
    """Measures and verdict for every document row.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, then ``line_words`` (words in
    the document's different lines), ``removed_words`` (of those, in lines above the host's limits) and ``kept``.

    Different documents of a host are told apart by their text, so exact copies count once: a copied
    document does not turn its own lines into boilerplate. A line above both limits is removed; a document left with less than
    ``least_left_percent`` of its words is rejected. Of lines only hashes travel.

    Null texts are empty: no words, base_failed. Null hosts are one host. Null ids are kept. Repeated rows get equal
    rows. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    whole = text_of(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).isNull().alias("_no_host"), F.coalesce(F.col(host), F.lit("")).alias("_host"),
        F.xxhash64(whole).alias("_content"), whole.alias("_text"), F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    filled = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    measured = with_once(rows, "_h", F.col("_hashes")).select(
        "doc_id", "_no_host", "_host", "_content", "_h", F.size("_h").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(filled))).cast("bigint").alias("n_dup_lines"),
        F.array_distinct(F.transform(normal_lines(F.col("_text")), lambda x: F.struct(
            F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))).alias("_lines"),
    )
    for name, step in repeated_words("_h"):
        measured = with_once(measured, name, step)
    base = staged(measured.drop("_h", "_windows", "_ordered", "_places"), "lines")

    found = base.select("doc_id", "_no_host", "_host", "_content", F.explode("_lines.h").alias("_line"))
    different = base.groupBy("_no_host", "_host").agg(F.count_distinct("_content").alias("_docs"))
    common = (
        found.groupBy("_no_host", "_host", "_line").agg(F.count_distinct("_content").alias("_with"))
        .where(F.col("_with") > limit_docs)
        .join(different, ["_no_host", "_host"])
        .where(F.col("_with") * 1000 > F.col("_docs") * limit_per_mille)
        .select("_no_host", "_host", "_line", F.explode(F.sequence(F.lit(0), F.lit(LINE_SALTS - 1))).alias("_salt"))
    )
    removed = (
        found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_content"), F.lit(LINE_SALTS)).cast("int"))
        .join(common, ["_no_host", "_host", "_line", "_salt"])
        .groupBy(F.col("doc_id").alias("_id"), F.col("_content").alias("_text_hash"), F.col("_no_host").alias("_no"), F.col("_host").alias("_h"))
        .agg(F.collect_set("_line").alias("_gone"))
    )
    same = (base["doc_id"].eqNullSafe(removed["_id"]) & (base["_content"] == removed["_text_hash"])
            & (base["_no_host"] == removed["_no"]) & (base["_host"] == removed["_h"]))
    total = lambda a: F.aggregate(F.transform(a, lambda x: x["w"]), F.lit(0), lambda s, w: s + w).cast("bigint")
    gone = F.filter("_lines", lambda x: F.array_contains("_gone", x["h"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        base.join(removed, same, "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                total(F.col("_lines")).alias("line_words"),
                F.when(F.col("_gone").isNull(), F.lit(0).cast("bigint")).otherwise(total(gone)).alias("removed_words"))
        .withColumn("kept", ~F.col("base_failed") & (
            100 * (F.col("line_words") - F.col("removed_words")) >= least_left_percent * F.col("line_words")))
    )

"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plotweave.functions.paths import content_addressed_layout
from plotweave.operators.features import feature_to_json, strip_properties


def geojson_sink(features: DataFrame, path: str, layer_name: str = "", url: str = "") -> DataFrame:
    """Write features one per line, in parallel; returns the export's summary row.

    The count is observed while writing, so the features are neither computed nor read a second time.
    """
    written = Observation()
    lines = features.select(feature_to_json(features).alias("value"))
    lines.observe(written, F.count("*").alias("feature_count")).write.mode("overwrite").text(path)
    summary = {
        "layer_name": layer_name, "filename": path.rstrip("/").rsplit("/", 1)[-1], "filepath": path,
        "feature_count": written.get["feature_count"], "url": url,
    }
    return features.sparkSession.range(1).select(*[
        F.lit(v).cast("bigint" if k == "feature_count" else "string").alias(k) for k, v in summary.items()
    ])


def geojson_collections_sink(features: DataFrame, path: str, by: str, per_collection: int) -> None:
    """Write whole collections, one per line, of at most ``per_collection`` features of one ``by`` group.

    ``pos`` numbers the features of a group from 0. The bound keeps a line, and a task's memory, small
    however large the group is.
    """
    chunk = F.floor(F.col("pos") / per_collection).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("pos", feature_to_json(features).alias("text"))))
    joined = F.array_join(F.transform(listed, lambda f: f.text), ",")
    lines = features.groupBy(by, chunk.alias("_chunk")).agg(joined.alias("_features")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "_features", F.lit("]}")).alias("value")
    )
    lines.write.mode("overwrite").text(path)


def geojson_export_full(features: DataFrame, path: str) -> DataFrame:
    return geojson_sink(features, path)


def geojson_export_geometry_only(features: DataFrame, path: str) -> DataFrame:
    """Export with geometry and ``{id}`` only."""
    return geojson_sink(strip_properties(features), path)


def metadata_sink(df: DataFrame, path: str) -> None:
    """One JSON folder per state and municipality.

    Rows are rebalanced by folder: small folders share a task and get one file each, a folder with very
    many rows is split over several tasks.
    """
    by_folder = df.hint("rebalance", "state_abbrev", "municipality")
    by_folder.write.mode("overwrite").partitionBy("state_abbrev", "municipality").json(path)


def content_store_sink(files: DataFrame, path: str) -> None:
    """Catalog of stored objects, laid out by the two-character hash prefix of their keys."""
    keyed = files.withColumn("object_key", content_addressed_layout(F.col("md5"))).withColumn("prefix2", F.substring("md5", 1, 2))
    keyed.hint("rebalance", "prefix2").write.mode("overwrite").partitionBy("prefix2").parquet(path)


def manifest_sink(manifest: DataFrame, path: str, per_shard: int = 100_000) -> None:
    """Write a manifest as numbered shards of JSON arrays, in ``ord`` ranges.

    Shards are keyed by ``ord`` range, so each holds a bounded number of entries and no task sees all.
    """
    shard = F.floor(F.col("ord") / per_shard).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("ord", "md5", "relpath")))
    plain = F.transform(listed, lambda e: F.struct(e.md5.alias("md5"), e.relpath.alias("relpath")))
    lines = manifest.groupBy(shard.alias("shard")).agg(F.to_json(plain).alias("value"))
    lines.write.mode("overwrite").partitionBy("shard").text(path)

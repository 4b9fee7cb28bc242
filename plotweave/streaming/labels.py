"""Label changes from a stream, merged into a stored label table."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plotweave.operators.labels import LABEL_PAYLOAD, latest_label
from plotweave.schemas import CORNER_COLUMNS

#: File groups of a label table. Fixed for the life of a table; more buckets for more labels.
BUCKETS = 64

STATE_SCHEMA = (
    "pdf_hash STRING, pdf_path STRING, "
    + ", ".join(f"{c} DOUBLE" for c in CORNER_COLUMNS)
    + ", created_at TIMESTAMP, updated_at TIMESTAMP, event_id BIGINT, deleted BOOLEAN, bucket INT"
)


def _bucket(buckets: int) -> Column:
    """Bucket of a hash, from its even leading digits."""
    return F.pmod(F.conv(F.substring("pdf_hash", 1, 4), 16, 10).cast("int"), F.lit(buckets)).alias("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path: JavaObject = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path: JavaObject = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """Current labels of a stored table."""
    return _state(spark, path).where(~F.col("deleted")).drop("deleted", "event_id", "bucket")


def _state(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(STATE_SCHEMA)
    return reader.parquet(path) if _exists(spark, path) else spark.createDataFrame([], STATE_SCHEMA)


def _check_buckets(spark: SparkSession, table: str, buckets: int) -> None:
    """Note the bucket count with a new table; refuse another one later, which would look for hashes in the wrong places."""
    note = f"{table.rstrip('/')}/_buckets"
    if not _exists(spark, f"{note}/_SUCCESS"):
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(note)
    noted = spark.read.schema("buckets INT").json(note).first()["buckets"]
    if noted != buckets:
        raise ValueError(f"{table} has {noted} buckets, not {buckets}")


def merge_changes(state: DataFrame, changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State after the changes: per hash the later of stored and new, by (time, event id).

    A deletion stays as a marker with its time, so an older save that arrives late cannot bring the
    label back. The creation time is that of the save which brought the label into being.
    """
    new = changes.select("pdf_hash", F.struct("ts", "event_id", (F.col("op") == "delete").alias("deleted"), *LABEL_PAYLOAD).alias("n"))
    old = state.select("pdf_hash", F.struct("created_at", "updated_at", "event_id", "deleted", *LABEL_PAYLOAD).alias("o"))
    both = old.join(new, "pdf_hash", "full")
    wins = F.col("o").isNull() | (
        F.struct(F.col("n.ts"), F.col("n.event_id")) > F.struct(F.col("o.updated_at"), F.col("o.event_id"))
    )
    wins = F.col("n").isNotNull() & F.coalesce(wins, F.lit(False))
    pick = lambda name, old_name=None: F.when(wins, F.col(f"n.{name}")).otherwise(F.col(f"o.{old_name or name}"))
    fresh = F.col("o").isNull() | F.col("o.deleted")
    created = (
        F.when(~wins, F.col("o.created_at"))
        .when(F.col("n.deleted"), F.lit(None).cast("timestamp"))
        .when(fresh, F.col("n.ts"))
        .otherwise(F.col("o.created_at"))
    )
    return both.select(
        "pdf_hash", *[pick(c).alias(c) for c in LABEL_PAYLOAD],
        created.alias("created_at"), pick("ts", "updated_at").alias("updated_at"),
        pick("event_id").alias("event_id"), pick("deleted").alias("deleted"), _bucket(buckets),
    )


def apply_batch(changes: DataFrame, batch_id: int, table: str, copies: str, buckets: int = BUCKETS) -> None:
    """Merge one micro-batch into the table; safe to repeat.

    Only the buckets the batch touches are read and rewritten. The merged buckets are first written
    aside in full, then moved into the table by a dynamic overwrite: if a run dies in between, the
    repeated batch finds its complete copy and only moves it again. ``copies`` is the folder for them; it
    belongs to one run of batch numbers, so it lives and dies with the stream's checkpoint. Changes without a hash name
    no label and are left out.
    """
    spark = changes.sparkSession
    _check_buckets(spark, table, buckets)
    changes = changes.where(F.col("pdf_hash").isNotNull())
    staged = f"{copies.rstrip('/')}/batch_id={batch_id}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        last = latest_label(changes).withColumn("bucket", _bucket(buckets)).persist()
        try:
            touched = [r[0] for r in last.select("bucket").distinct().collect()]  # a few numbers
            if not touched:
                return
            state = _state(spark, table).where(F.col("bucket").isin(touched))
            merged = merge_changes(state, last.drop("bucket"), buckets)
            merged.hint("rebalance", "bucket").write.mode("overwrite").parquet(staged)
        finally:
            last.unpersist()
    (
        spark.read.schema(STATE_SCHEMA).parquet(staged).hint("rebalance", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(table)
    )
    # Only the last batch can be repeated, so the copies before it have served.
    _delete(spark, f"{copies.rstrip('/')}/batch_id={batch_id - 2}")


def label_stream_upsert(stream: DataFrame, table: str, checkpoint: str, timeout: int = 600,
                        buckets: int = BUCKETS) -> StreamingQuery:
    """Merge a stream of saves and deletes (``event_id, ts, op, pdf_hash`` and the payload) into a table.

    One query per table: there is a single writer.
    """
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, table, f"{checkpoint}/merged", buckets))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"label stream into {table} did not finish in {timeout} s")
    return query

"""Stateful streams without a table: landing, bursts and sampled positions.

Event times must be TIMESTAMP; a watermark rejects timestamps without zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def landing_stream(stream: DataFrame, key: Sequence[str], delay: str, ts: str = "ts", salts: int = 1) -> DataFrame:
    """Each key once within the re-delivery delay. Give it keys and small columns, not contents.

    State holds the keys of one delay; what comes back later still is caught by the batch anti-join
    with the inventory. Where one key may be delivered very often, ``salts`` above 1 first drops
    duplicates per key and share of the arrival times, so that its rows meet in that many tasks and only
    one row per share goes on to the key's own task.
    """
    timed = stream.withWatermark(ts, delay)
    if salts > 1:
        dealt = timed.withColumn("_salt", F.pmod(F.xxhash64(ts), F.lit(salts)))
        timed = dealt.dropDuplicatesWithinWatermark([*key, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(list(key))


def search_burst_collapse(stream: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """The last query of every burst of a user: queries closer than ``gap`` form one burst.

    Works on batches as well, without ``delay``. Sessions of a user are merged within each task before
    the shuffle (a session setting), so a busy user does not send all events to one task.
    """
    timed = stream.withWatermark("ts", delay) if delay else stream
    session = F.session_window("ts", gap)
    return timed.groupBy("user_id", session.alias("burst")).agg(
        F.max_by("query", F.struct("ts", "event_id")).alias("query"), F.count("*").alias("n_queries")
    ).select("user_id", F.col("burst.start").alias("burst_start"), "query", "n_queries")


def position_sampling(stream: DataFrame, every: str, delay: str | None = None) -> DataFrame:
    """The latest value of every key in each interval."""
    timed = stream.withWatermark("ts", delay) if delay else stream
    window = F.window("ts", every)
    return timed.groupBy("user_id", window.alias("slot")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    ).select("user_id", F.col("slot.start").alias("slot_start"), "value")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, timeout: int = 600) -> StreamingQuery:
    """Process what is available, append to a Parquet folder and stop.

    The file sink and the checkpoint together deliver each result once. Windows still open at the final
    watermark stay in the state for the next run.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream into {path} did not finish in {timeout} s")
    return query

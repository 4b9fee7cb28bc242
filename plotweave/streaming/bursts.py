"""Bursts of queries that end by silence: the last query of a burst comes out when its user has paused."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Part of a burst: first and last time in microseconds, the last query with its id, number of queries.
PART = "first_us BIGINT, last_us BIGINT, event_id BIGINT, query STRING, n_queries BIGINT"
COLUMNS = ["first_us", "last_us", "event_id", "query", "n_queries"]
NO_ID = -(2**63)


def merge_parts(parts: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Parts of bursts, joined per user where less than the gap lies between them; ordered by user and time.

    The query is that of the latest (time, event id). Parts may overlap and come in any order, so the result does not
    depend on how rows were dealt to tasks.
    """
    if parts.empty:
        return parts
    user = pd.factorize(parts["user"], use_na_sentinel=False)[0]
    order = np.lexsort((parts["first_us"], user))
    parts, user = parts.iloc[order].reset_index(drop=True), user[order]
    reached = parts["last_us"].groupby(user).cummax().to_numpy()
    fresh = np.ones(len(parts), dtype=bool)
    fresh[1:] = (user[1:] != user[:-1]) | (parts["first_us"].to_numpy()[1:] - reached[:-1] >= gap_us)
    burst = np.cumsum(fresh) - 1
    latest = np.lexsort((parts["event_id"], parts["last_us"], burst))
    ends = latest[np.append(burst[latest][1:] != burst[latest][:-1], True)]
    starts = np.flatnonzero(fresh)
    return parts.iloc[ends].assign(
        first_us=parts["first_us"].to_numpy()[starts], n_queries=np.add.reduceat(parts["n_queries"].to_numpy(), starts)
    ).reset_index(drop=True)


def search_idle_collapse(stream: DataFrame, gap_seconds: float, idle_seconds: float | None = None) -> DataFrame:
    """The last query of every burst of a user (``event_id, ts, user_id, query``), without waiting for a later event.

    Queries less than ``gap_seconds`` apart form one burst. A burst comes out when a later one of its user begins, or when
    nothing has come from the user for ``idle_seconds`` of clock time (by default the gap); then the user's state is gone. A query that comes
    after its burst came out begins another. Rows without time are left out; a null user is a user.

    Bursts are formed within every task before the shuffle, so a user with a large share of the events sends parts of
    bursts and not events to one task.
    """
    gap_us, idle_ms = round(gap_seconds * 1e6), max(1, round((gap_seconds if idle_seconds is None else idle_seconds) * 1000))
    kind = stream.schema["user_id"].dataType

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield merge_parts(batch, gap_us)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user = key[0]
        held = pd.DataFrame([state.get] if state.exists else [], columns=COLUMNS).assign(user=user)
        if state.hasTimedOut:
            state.remove()
            yield held[["user", *COLUMNS]]
            return
        parts = [held] if len(held) else []
        for batch in batches:
            parts.append(merge_parts(batch[["user", *COLUMNS]], gap_us))
        bursts = merge_parts(pd.concat(parts, ignore_index=True), gap_us)
        last = bursts.iloc[-1]
        state.update((int(last.first_us), int(last.last_us), int(last.event_id), last["query"], int(last.n_queries)))
        state.setTimeoutDuration(idle_ms)
        yield bursts.iloc[:-1][["user", *COLUMNS]]

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # Users as text and times as numbers: pandas turns integers with nulls into doubles.
    events = stream.where(F.col("ts").isNotNull()).select(
        F.col("user_id").cast("string").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(NO_ID)).alias("event_id"),
        "query", F.lit(1).cast("bigint").alias("n_queries"),
    )
    bursts = events.mapInPandas(local, f"user STRING, {PART}").groupBy("user").applyInPandasWithState(
        fold, f"user STRING, {PART}", PART, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return bursts.select(F.col("user").cast(kind).alias("user_id"), F.timestamp_micros("first_us").alias("burst_start"), "query", "n_queries")


def run_until_idle(stream: DataFrame, path: str, checkpoint: str, timeout: int = 600, every: str = "200 milliseconds") -> StreamingQuery:
    """Append to a Parquet folder until all input is read and no state is left, then stop.

    Time passes between the triggers, so what waits for a pause comes out without further input.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )
    deadline = time.monotonic() + timeout
    try:
        while time.monotonic() < deadline:
            if query.exception() is not None:
                raise query.exception()
            progress, status = query.lastProgress, query.status
            if progress is None:
                drained = status["message"].startswith("Waiting")  # nothing to read
            else:
                drained = progress["numInputRows"] == 0 and not any(op["numRowsTotal"] for op in progress["stateOperators"])
            if drained and not status["isDataAvailable"]:
                return query
            time.sleep(0.1)
        raise TimeoutError(f"stream into {path} did not finish in {timeout} s")
    finally:
        query.stop()

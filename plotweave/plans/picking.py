"""Keeping the first rows of every key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_pick(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    Written as row_number <= n, which Spark plans as a group limit before the shuffle: every
    map task sends at most ``n`` rows per key, so a key holding a third of all rows is no burden.
    The order should be total; dropDuplicates is no substitute, it keeps an arbitrary row.
    """
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return priority_pick(df, keys, order, 1)


def top_n_per_query(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return priority_pick(df, key, order, n)

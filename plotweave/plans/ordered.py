"""Row numbers and predecessors without collecting a key into one task.

A plain window moves all rows of a key to one task. Here the order is cut into segments, so a hot key
spreads over many tasks; what crosses segment borders is one small row per (key, segment).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a number segment.
SEGMENT_NUMBERS = 100_000


def time_segment(column: str) -> Column:
    """Hours of a time (timestamp, or seconds)."""
    return F.date_trunc("hour", F.col(column).cast("timestamp"))


def number_segment(column: str, width: int = SEGMENT_NUMBERS) -> Column:
    """Ranges of whole numbers."""
    return F.floor(F.col(column) / F.lit(width))


def _keyed(df: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], segment.alias("_at"))


def _on_segment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    same = [left["_segment"].eqNullSafe(right["_at"])] + [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return reduce(lambda a, b: a & b, same)


def segment_offsets(df: DataFrame, segment: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each (key, segment) and before it: ``_<key>..., _at, _rows, _before``, one row per pair."""
    counts = _keyed(df, keys, segment).groupBy(*[f"_{k}" for k in keys], "_at").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def ordered_row_number(df: DataFrame, order: Sequence[str | Column], segment: Column, keys: Sequence[str] = (),
                       name: str = "row_no", offsets: DataFrame | None = None) -> DataFrame:
    """1-based row number per key (or overall, without keys) in a total order.

    ``segment`` is a function of the row that never falls along the order (hours of a time, ranges of ids); it
    should change often enough that the rows of one (key, segment) suit a task. As nothing is sampled,
    a recomputed task numbers its rows alike.
    """
    rows = df.withColumn("_segment", segment)
    before = segment_offsets(df, segment, keys) if offsets is None else offsets
    within = Window.partitionBy(*keys, "_segment").orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(within))
    joined = numbered.join(before, _on_segment(numbered, before, keys))
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_before") + F.col("_in")).alias(name))


def ordered_slice(df: DataFrame, order: Sequence[str | Column], segment: Column, offset: int, n: int) -> DataFrame:
    """Rows ``offset .. offset + n`` of a total order: segments are counted, and only those of the slice are sorted."""
    offsets = segment_offsets(df, segment).where((F.col("_before") < offset + n) & (F.col("_before") + F.col("_rows") > offset))
    rows = df.withColumn("_segment", segment)
    wanted = rows.join(offsets, _on_segment(rows, offsets, []), "left_semi").select(*df.columns)
    numbered = ordered_row_number(wanted, order, segment, name="_no", offsets=offsets)
    return numbered.where((F.col("_no") > offset) & (F.col("_no") <= offset + n)).drop("_no")


def ordered_lag(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str | Column], segment: Column,
                name: str = "previous") -> DataFrame:
    """Value of the preceding row of the same key, null for the first one; ``segment`` as for row numbers."""
    rows = df.withColumn("_segment", segment)
    last = df.select(*[F.col(k).alias(f"_{k}") for k in keys], segment.alias("_at"), F.struct(value).alias("_value"), F.struct(*order).alias("_order")).groupBy(
        *[f"_{k}" for k in keys], "_at").agg(F.max_by("_value", "_order").alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at"))).drop("_last")
    local = rows.withColumn("_local", F.lag(F.struct(value)).over(Window.partitionBy(*keys, "_segment").orderBy(*order)))
    joined = local.join(carried, _on_segment(local, carried, keys))
    # A struct keeps a null value apart from "no preceding row".
    chosen = F.when(F.col("_local").isNull(), F.col("_carry")).otherwise(F.col("_local"))
    return joined.select(*[local[c] for c in df.columns], chosen.getField(value).alias(name))

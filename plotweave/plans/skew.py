"""Joins on keys of which some hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task may take before the key is split.
HOT_ROWS = 2_000_000
#: Over how many salts rows without a key are dealt.
KEYLESS_SALTS = 4096
#: Left rows and right values of a key that meet in one block, of 17 million rows.
BLOCK_ROWS, BLOCK_VALUES = 2048, 8192
#: Words of 64 bits in a bitmap of keys.
MARKS = 1 << 16


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                hot_rows: int = HOT_ROWS, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Equi-join in which keys with more than ``hot_rows`` left rows are split over several tasks.

    ``salt_by`` names left columns that tell the rows of a key apart (rows equal in all of them stay
    together); the salt is a hash of them, so a recomputed task deals the rows out the same way. Only right rows of hot keys are copied.
    The table of hot keys holds at most ``rows / hot_rows`` entries, whatever the data looks like,
    which is why it may be broadcast. Left rows without a key match nothing, so in a left or anti join they are
    dealt out freely. The plan is the same for inputs of every size: what is hot is counted, not estimated, and the two sides meet in a
    merge join, since the size Spark expects of a side does not tell how many rows its explodes make. ``counts``, where a caller has them, are the
    keys with the number of their left rows, ``_rows``; they save counting.
    """
    if how not in ("inner", "left", "left_anti"):
        raise ValueError("a salted join copies right rows, so it supports inner, left and left anti joins only")
    hot = (
        (left.groupBy(*keys).agg(F.count("*").alias("_rows")) if counts is None else counts)
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    dealt = left.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_by), F.when(keyless, KEYLESS_SALTS).otherwise(salts)).cast("int")
    ).drop("_salts")
    copied = right.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return dealt.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, key: str, deal_by: str, value: str,
               rows: int = BLOCK_ROWS, values: int = BLOCK_VALUES) -> DataFrame:
    """Equi-join of ``left`` with the column ``value`` of ``right``, in which a key may have many rows on both sides.

    What a key gives grows with the product of its sides, so neither side tells how much work it is. Left rows are dealt by
    ``deal_by``, a column of hashes, and right values by their own, into blocks of about ``rows`` times ``values``. A block is one
    task's work, and each side is copied only as often as the other has blocks. The values of a block come as one array; rows or values
    equal in what they are dealt by stay together. Keys with several blocks are at most one in ``rows`` or ``values`` rows, which is why
    they may be broadcast. The number of tasks is given, for the bytes of a block do not tell what it gives.
    """
    several = lambda df, n, name: F.broadcast(
        df.groupBy(key).agg(F.ceil(F.count("*") / n).cast("int").alias(name)).where(F.col(name) > 1))
    lefts, rights = several(left, rows, "_lefts"), several(right, values, "_rights")
    number = lambda name: F.coalesce(F.col(name), F.lit(1))
    block = lambda hashed, name: F.pmod(hashed, number(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), number(name) - 1))
    dealt = left.join(lefts, key, "left").join(rights, key, "left").withColumns(
        {"_i": block(F.col(deal_by), "_lefts"), "_j": each("_rights")}).drop("_lefts", "_rights")
    # A list of structs keeps nulls.
    packs = right.where(F.col(key).isNotNull()).join(rights, key, "left").groupBy(key, block(F.xxhash64(value), "_rights").alias("_j")).agg(
        F.transform(F.collect_list(F.struct(value)), lambda v: v[value]).alias("_values"))
    copied = packs.join(lefts, key, "left").withColumn("_i", each("_lefts")).drop("_lefts")
    tasks, on = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [key, "_i", "_j"]
    met = dealt.repartition(tasks, *on).join(copied.repartition(tasks, *on).hint("merge"), on)
    return met.withColumn(value, F.explode("_values")).drop("_i", "_j", "_values")


def marked(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose column ``on`` may be among the ``keys``: all that are, and few others while there are fewer than some million keys.

    A bitmap of fixed size is broadcast, whatever the number of keys. It saves a join from shuffling what it would drop.
    """
    bit, at = F.pmod(F.xxhash64(on), F.lit(64 * MARKS)), (F.col("_bit") % 64).cast("int")
    placed = lambda rows: rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    bitmap = placed(keys.select(on)).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    return placed(df).join(F.broadcast(bitmap), "_word").where(F.getbit("_bits", at) == 1).select(*df.columns)


def saltable(df: DataFrame) -> list[str]:
    """Columns that a salt can be made of: those that Spark can hash."""
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def missing_from(left: DataFrame, right: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have; hot keys are split. Rows without a key have no match and stay."""
    known = right.select(on).where(F.col(on).isNotNull()).distinct()
    return salted_join(left, known, [on], saltable(left), hot_rows, "left_anti").select(*left.columns)

"""Words, lines, matched spans and shared staging used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.session import staging_path

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def text_of(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null, empty and blank texts."""
    return F.array_remove(F.split(text_of(text), SPACES), "")


#: Tells Spark to remove the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that later steps neither repeat nor change them.

    The write shares no shuffle with other jobs, so its shuffle files go with it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def fraction(name: str) -> Column:
    """A number in (0, 1) that follows from a string column: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.col(name)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)

"""Costly expressions, evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, costly: Column) -> DataFrame:
    """Add a column whose expression Spark does not copy into later filters and projections.

    Catalyst moves a filter below the projection it refers to by copying the expression, so that a
    document parsed for a check and for its content is parsed twice. A filter on the output of a
    generator stays above it; the generator here yields exactly one row.
    """
    return df.select("*", F.explode(F.array(costly)).alias(name))

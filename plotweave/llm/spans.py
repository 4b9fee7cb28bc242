"""Matches of a pattern with their places, without leaving SQL functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string>"


def named(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches as ``array<struct<s, e, m>>``: code points from 0, end exclusive.

    Splitting at a pattern yields what lies between its matches; running sums of both lengths are the places.
    Patterns must not match the empty string.
    """
    place = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
        F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(
            (acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"))
    empty = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, start, place, lambda acc: acc["out"]))

    return named(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end``, comma-joined, of spans with a ``kind`` number."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def apart_from(span: Column, others: Column) -> Column:
    """True if a span overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["s"] < span["e"]) & (span["s"] < o["e"]))

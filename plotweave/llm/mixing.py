"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import fraction, staged, text_of, words_of

#: Slices of the key space into which every source is cut, whatever its size, so that no source is sorted in one task.
SLICES = 1024
#: Source weights by rank, repeated. Fixed values of the mix.
RANK_WEIGHTS = (1, 2, 3)
#: A source is read this many times at most.
MOST_EPOCHS = 3


def symbol_quality(text: Column) -> Column:
    """Quality weight from 0.1 to 1: falls with the share of markup and currency signs in a text."""
    whole = text_of(text)
    signs = F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * signs / F.greatest(F.length(whole), F.lit(1)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (``_no_source, _source, source_size``; one row each).

    Shares of the total by weight; a share above ``MOST_EPOCHS`` times the size stops there and its excess is
    shared again by weight. That is water-filling: with sources in order of (limit / weight), the level
    is the one at which the first source that stays below its limit fixes it. The table has one row per
    source, so its windows are small however many documents there are.
    """
    named = Window.orderBy("_no_source", "_source")
    weight = F.element_at(F.array(*[F.lit(w) for w in RANK_WEIGHTS]), (F.row_number().over(named) - 1) % len(RANK_WEIGHTS) + 1)
    sized = sizes.withColumn("_weight", weight.cast("double")).withColumn("_limit", MOST_EPOCHS * F.col("source_size"))
    filled = Window.orderBy(F.col("_limit") / F.col("_weight"), "_no_source", "_source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    leveled = sized.withColumn("_level", level).withColumn("_turn", F.row_number().over(filled))
    free = F.when(F.col("_limit") / F.col("_weight") >= F.col("_level"), F.struct("_turn", "_level"))
    final = F.coalesce(F.min(free).over(every)["_level"], F.lit(0.0))
    return leveled.select(
        "_no_source", "_source", "source_size",
        F.least(F.col("_limit").cast("double"), final * F.col("_weight")).alias("target"),
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                quality: Column | None = None, slices: int = SLICES) -> DataFrame:
    """What a mix takes of every document: ``doc_id, source, size, source_size, target, taken``.

    A source's target in words is met by whole passes over it first; the rest comes from its documents in order of
    Efraimidis-Spirakis keys, ``-ln(u) / quality`` with ``u`` from a hash of id and text, until the prefix sum of sizes
    reaches it. The document at the border is taken if that comes nearer to the target, so a source
    misses it by half a document at most. Nothing is drawn at random: reruns agree.

    Sorting and prefix sums are done per slice of the key space (a fixed function of the key); sums of slices, at most
    ``slices`` rows per source, carry the prefix over. So a source with a third of all rows spreads over tasks.

    Null or blank texts have size 0 and take 0 words. Null sources form one source, ranked last. Null ids
    are kept. Repeated rows are documents of their own; which of two equal rows is taken at a border makes no
    difference. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    whole = text_of(F.col(text))
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole)).alias("_seed"),
        (symbol_quality(F.col(text)) if quality is None else quality).cast("double").alias("_quality"),
    )
    rows = staged(measured, "mix").withColumns({
        "_no_source": F.col("source").isNull(), "_source": F.coalesce(F.col("source"), F.lit("")),
        "_key": -F.log(fraction("_seed")) / F.col("_quality"),
    }).withColumn("_slice", F.least(F.floor((1 - F.exp(-F.col("_key"))) * slices), F.lit(slices - 1)).cast("int"))

    per_slice = rows.groupBy("_no_source", "_source", "_slice").agg(F.sum("size").alias("_in_slice"))
    targets = source_targets(per_slice.groupBy("_no_source", "_source").agg(F.sum("_in_slice").alias("source_size")))
    earlier = Window.partitionBy("_no_source", "_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("_before_slice", F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0))).drop("_in_slice")
    starts = offsets.join(targets, ["_no_source", "_source"])

    within = Window.partitionBy("_no_source", "_source", "_slice").orderBy("_key", "doc_id", "_seed").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["_no_source", "_source", "_slice"]).withColumn(
        "_before", F.col("_before_slice") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    again = F.when(F.col("_before") + F.col("size") / 2 <= rest, F.lit(1)).otherwise(F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (epochs + again)).cast("bigint").alias("taken"),
    )

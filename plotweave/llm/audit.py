"""What a chain of filters removes in every order of the filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of, words_of
from plotweave.plans.once import with_once
from plotweave.plans.skew import salted_join

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lehmer_rank(order: str, letters: str = FILTERS) -> int:
    """Place of a beginning of a permutation among all permutations in lexicographic order: that of the first that begins so."""
    left, rank = list(letters), 0
    for letter in order:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def removal_intervals(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """``(mask, step, from, to)``: a document that fails the filters of ``mask`` goes at ``step`` in the permutations ranked ``from`` to ``to - 1``.

    It goes with the first filter it fails. Permutations that begin with some filters it passes and then one it fails have ranks in a
    row. For each mask the intervals of all steps cover every rank once.
    """
    found = []
    for mask in range(1, 1 << len(letters)):
        failed = [c for i, c in enumerate(letters) if mask >> i & 1]
        passed = [c for c in letters if c not in failed]
        for before in range(len(passed) + 1):
            for start in permutations(passed, before):
                for last in failed:
                    at = lehmer_rank("".join(start) + last, letters)
                    found.append((mask, before + 1, at, at + factorial(len(letters) - before - 1)))
    return found


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails; ``words`` are its words."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 80 * F.size(words).cast("bigint"),
        100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"),
        F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by the filters they fail: ``part, mask, n, good, toxic``, one row per part and mask that occurs.

    A to D follow from the text. E fails a document whose text (by its SHA-256) a smaller id has anywhere in the table. ``good`` and ``toxic`` count
    documents that some row of ``labels`` marks so.

    Null texts are empty ones, a null part is the empty one. A null id is smaller than none, fails E never and has no labels. Rows that repeat an
    id count each; the smallest id of a text passes E as often as it occurs. Other columns are ignored.

    Copies of a text are counted before the shuffle, and the first id of a text meets its rows by (text, id), so a text with any number of copies
    is no hot key.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_of(F.col(text)).alias("_text"))
    masked = with_once(texts, "_words", words_of(F.col("_text"))).select(
        "doc_id", "part", F.sha2("_text", 256).alias("_sha"), text_mask(F.col("_text"), F.col("_words")).alias("_mask"))
    rows = staged(masked.groupBy("doc_id", "part", "_sha", "_mask").agg(F.count("*").alias("n")), "masks")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    marked = salted_join(rows, marks, ["doc_id"], ["_sha", "part"], how="left")
    first = rows.where("doc_id IS NOT NULL").groupBy("_sha").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copies = F.when(F.col("doc_id").isNotNull() & F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return marked.join(first, ["_sha", "doc_id"], "left").groupBy("part", (F.col("_mask") + copies).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """What every filter does at every step of every order, from ``counts (part, mask, n, good, toxic)``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: a row per part, permutation and step.

    Counts of a mask are added where an interval of ranks begins and taken off where it ends; sums over the ranks then
    give all permutations at once. Nothing but counts of masks is read: 2^k rows a part at most.
    """
    spark, k = counts.sparkSession, len(letters)
    orders = factorial(k)
    intervals = spark.createDataFrame(removal_intervals(letters), "mask INT, step INT, _from INT, _to INT")
    values = ("n", "good", "toxic")
    met = counts.join(F.broadcast(intervals), "mask")
    ends = met.select("part", "step", F.col("_from").alias("_at"), *values).union(
        met.where(F.col("_to") < orders).select("part", "step", F.col("_to").alias("_at"), *[-F.col(v) for v in values]))
    changes = ends.groupBy("part", "step", "_at").agg(*[F.sum(v).alias(v) for v in values])

    bits = [1 << i for i in range(k)]
    per_part = counts.groupBy("part").agg(
        F.sum("n").alias("_total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(b)) > 0, F.col("n")).otherwise(0)) for b in bits]).alias("_fails"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bits]).alias("_unique"))
    grid = per_part.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    so_far = Window.partitionBy("part", "step").orderBy("_at")
    sums = grid.join(changes, ["part", "step", "_at"], "left").select(
        *grid.columns, *[F.sum(F.coalesce(v, F.lit(0))).over(so_far).alias(v) for v in values])

    names = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    order = F.get(names, F.col("_at"))
    letter = F.instr(F.lit(letters), F.col("_letter")) - 1
    lettered = sums.withColumn("filter_order", order).withColumn("_letter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    done = F.sum("n").over(Window.partitionBy("part", "_at").orderBy("step"))
    return lettered.select(
        "part", "filter_order", "step", (F.col("_total") - done).alias("kept"), F.col("n").alias("removed"),
        (F.get("_fails", letter) - F.col("n")).alias("redundant"), F.get("_unique", letter).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "_letter")).alias("shapley"))

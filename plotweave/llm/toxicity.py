"""Toxicity by a classifier chain: each category's model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plotweave.llm.common import text_of, words_of
from plotweave.llm.quality import in_held_out
from plotweave.plans.once import with_once

#: Hashed whole words, then hashed beginnings of longer words.
WORDS, STEMS = 1 << 20, 1 << 17
STEM_LETTERS = (4, 6)
#: Labelled rows per class the chain is fitted on at most: those of least hash.
SAMPLE_ROWS = 6_000
#: Marks are kept whose log-odds stand out by so many standard errors and that are in so many toxic rows.
LEAST_Z, LEAST_ROWS = 3.0, 4
FOLDS = 5
#: The chain, in order. The label tells toxic rows; how far a toxic row's share of marks is over or under
#: the median of toxic rows tells severe from mild ones.
CATEGORIES = ("severe", "mild", "toxic")


def marks_of(text: Column) -> Column:
    """Different hashed words and word beginnings of a text, signs left out, lower case."""
    plain = words_of(F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}\p{N}\s]+", ""))
    word = F.transform(plain, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int"))
    return F.array_distinct(F.concat(word, *[_stems(plain, n) for n in STEM_LETTERS]))


def _stems(words: Column, letters: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > letters),
                       lambda w: (F.pmod(F.xxhash64(F.substring(w, 1, letters)), F.lit(STEMS)) + WORDS).cast("int"))


@dataclass
class Chain:
    """``marks`` are the kept features in order; a row of ``weights`` per category: marks, earlier probabilities, constant."""

    marks: np.ndarray
    weights: list[np.ndarray]
    shift: np.ndarray

    def columns(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Owning row and kept mark of every hit in a batch."""
        offsets = lists.offsets.to_numpy()
        found = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
        if not len(self.marks):
            return owner[:0], found[:0]
        at = np.minimum(np.searchsorted(self.marks, found), len(self.marks) - 1)
        hit = self.marks[at] == found
        return owner[hit], at[hit]

    def probabilities(self, owner: np.ndarray, mark: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, len(self.weights)))
        n = len(self.marks)
        for c, w in enumerate(self.weights):
            z = np.bincount(owner, w[mark], minlength=rows) + out[:, :c] @ w[n:n + c] + w[-1] + self.shift[c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _logistic(owner: np.ndarray, mark: np.ndarray, extra: np.ndarray, y: np.ndarray, n: int, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic model over sparse marks and dense extra columns, by Adam with a small ridge."""
    rows, k = extra.shape
    w = np.zeros(n + k + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[mark], minlength=rows) + extra @ w[n:n + k] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / rows
        g = np.r_[np.bincount(mark, d[owner], minlength=n), extra.T @ d, d.sum()] + 1e-4 * np.r_[w[:-1], 0]
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def fit_chain(lists: pa.ListArray, toxic: np.ndarray, share: float) -> Chain:
    """A chain from labelled rows. ``share`` is the share of toxic rows among all labelled ones.

    Marks are chosen by log-odds on these rows. Each category's model is fitted with the earlier categories' probabilities
    as further columns; those come from models of the other folds, so that they are as good as on new rows.
    """
    rows = len(lists)
    offsets = lists.offsets.to_numpy()
    found = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    a = np.bincount(found, toxic[owner], minlength=WORDS + STEMS)
    b = np.bincount(found, minlength=WORDS + STEMS) - a
    pos, neg = toxic.sum(), rows - toxic.sum()
    odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (pos - a + 0.5) + 1 / (b + 0.5) + 1 / (neg - b + 0.5))
    chain = Chain(np.flatnonzero((odds / error >= LEAST_Z) & (a >= LEAST_ROWS)).astype(found.dtype), [], np.zeros(len(CATEGORIES)))
    owner, mark = chain.columns(lists)
    n = len(chain.marks)
    rate = np.bincount(owner, minlength=rows) / np.maximum(np.diff(offsets), 1)
    median = np.median(rate[toxic == 1]) if pos else 0.0
    target = {"toxic": toxic, "severe": toxic * (rate >= median), "mild": toxic * (rate < median)}
    fold = np.random.default_rng(11).permutation(rows) % FOLDS
    earlier = np.zeros((rows, 0))
    for c, name in enumerate(CATEGORIES):
        y = target[name].astype(float)
        out_of_fold = np.zeros(rows)
        for f in range(FOLDS):
            inside = fold != f
            use = inside[owner]
            place = np.cumsum(inside) - 1
            w = _logistic(place[owner[use]], mark[use], earlier[inside], y[inside], n)
            z = np.bincount(owner, w[mark], minlength=rows) + earlier @ w[n:n + c] + w[-1]
            out_of_fold[fold == f] = 1 / (1 + np.exp(-np.clip(z[fold == f], -40, 40)))
        chain.weights.append(_logistic(owner, mark, earlier, y, n))
        earlier = np.c_[earlier, out_of_fold]
    # The sample holds more toxic rows than the labels do; move the odds of the last model back.
    if 0 < share < 1 and pos and neg:
        chain.shift[-1] = np.log(share / (1 - share)) - np.log(pos / neg)
    return chain


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                 sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain fitted on labelled rows that are not held out, ``sample_rows`` per class at most.

    Samples hold the ids of least hash. Ids labelled twice count with their higher label. Without toxic rows nothing is a mark
    and nothing is toxic.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    # At most sample_rows ids per class: a bounded table, small enough for every task.
    sample = known.where("_label = 1").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).union(
        known.where("_label = 0").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    labelled = own.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "_label", marks_of(F.col("_text")).alias("marks"))
    rows = labelled.orderBy(F.xxhash64("_id"), "_id", F.size("marks")).limit(2 * sample_rows).toArrow()
    lists = rows.column("marks").combine_chunks()
    toxic = rows.column("_label").to_numpy().astype(np.float64)
    total = sum(counts.values())
    return fit_chain(lists, toxic, counts.get(1, 0) / total if total else 0.0)


def with_toxicity(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All rows and columns with a probability per category (``p_severe, p_mild, p_toxic``).

    Null, empty and blank texts have no marks and get the probabilities of a text without any. Words of very long texts all
    count; each mark counts once. Equal texts get equal probabilities; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def judge(marks: pa.Array) -> pa.Array:
        owner, mark = shared.value.columns(marks)
        p = shared.value.probabilities(owner, mark, len(marks))
        offsets = pa.array(np.arange(len(marks) + 1) * p.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1)))

    judge.__annotations__ = {"marks": pa.Array, "return": pa.Array}
    marked = with_once(docs, "_tx_marks", marks_of(F.col(text)))
    judged = marked.withColumn("_tx_p", F.arrow_udf(judge, ArrayType(DoubleType()))("_tx_marks"))
    return judged.select(*docs.columns, *[F.element_at("_tx_p", i + 1).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)])

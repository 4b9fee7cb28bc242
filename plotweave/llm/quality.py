"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plotweave.llm.common import text_of, words_of
from plotweave.plans.once import with_once

#: Hashed words and hashed word shapes that have a vector each; the last ones are shapes. Shape 0 marks a repeated word.
WORDS, SHAPES = 1 << 14, 1 << 10
DIMENSIONS = 32
#: Words on either side that make up a context.
REACH = 2
#: Labelled rows the network is fitted on at most: those of least hash.
SAMPLE_ROWS = 20_000
#: Tasks that add up the vectors of all scans before one task per block does.
PARTIAL_SUMS = 16
BLOCK = 1024
HIDDEN = 32
CHUNK = 1 << 17


def tokens_of(text: Column) -> Column:
    """A number per word: hashed word (lower case) * SHAPES + hashed shape (letters as A or a, digits as 0)."""
    whole = text_of(text)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "0")
    number = lambda w, s: (F.pmod(F.xxhash64(w), F.lit(WORDS)) * SHAPES + F.pmod(F.xxhash64(s), F.lit(SHAPES - 1)) + 1).cast("int")
    return F.zip_with(words_of(F.lower(whole)), words_of(shape), number)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs per token: the sparse random index vectors, the same on every machine."""
    ids = np.arange(WORDS + SHAPES, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.stack([(mixed >> np.uint64(s)) % np.uint64(DIMENSIONS) for s in (8, 24)], axis=1).astype(np.int64)
    sign = np.stack([((mixed >> np.uint64(s)) & np.uint64(1)).astype(np.int64) * 2 - 1 for s in (40, 41)], axis=1)
    return place, sign


def _unpacked(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, shapes and owning row of all tokens of a batch; a word like the one before gets shape 0."""
    offsets = lists.offsets.to_numpy()
    packed = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    word, shape = packed // SHAPES, packed % SHAPES
    shape[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])] = 0
    return word, shape + WORDS, owner


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors of what stands around each token, over all batches of a task."""
    place, sign = _index_vectors()
    size = (WORDS + SHAPES) * DIMENSIONS
    sums = np.zeros(size)
    for batch in batches:
        word, shape, owner = _unpacked(batch.column(0))
        for start in range(0, len(word), CHUNK):
            w, s, o = (x[max(0, start - REACH):start + CHUNK] for x in (word, shape, owner))
            for lag in range(1, REACH + 1):
                near = o[lag:] == o[:-lag]
                if start:  # pairs within the overlap were counted with the chunk before
                    near[:REACH - lag] = False
                left, right = np.flatnonzero(near), np.flatnonzero(near) + lag
                for a, b in ((left, right), (right, left)):
                    for target in (w[a], s[a]):
                        for context in (w[b], s[b]):
                            for k in range(2):
                                sums += np.bincount(target * DIMENSIONS + place[context, k], sign[context, k], minlength=size)
    yield from _as_blocks(sums)


def _as_blocks(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = sums.reshape(-1, BLOCK * DIMENSIONS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(blocks)), pa.int32()), pa.array([b.astype(np.float64).tobytes() for b in blocks], pa.binary())], ["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks, one after the other, in as much memory as one matrix takes."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(sums.as_buffer(), dtype=np.float64)
            total[block] = total[block] + values if block in total else values.copy()
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A unit vector per hashed word and shape, from the contexts in all documents.

    Every scan task keeps one matrix of fixed size; matrices are added in two steps. What comes here is one
    matrix (4.5 MB), whatever the corpus holds. Sums of whole numbers are exact, so their order makes no difference.
    """
    schema = "block int, sums binary"
    partial = docs.select(tokens_of(F.col(text)).alias("tokens")).mapInArrow(_contexts, schema)
    some = partial.withColumn("_task", F.spark_partition_id() % PARTIAL_SUMS).repartition(PARTIAL_SUMS, "_task").select("block", "sums")
    blocks = some.mapInArrow(_added, schema).repartition("block").mapInArrow(_added, schema)
    vectors = np.zeros((WORDS + SHAPES, DIMENSIONS))
    for row in blocks.collect():
        vectors[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["sums"]).reshape(BLOCK, DIMENSIONS)
    # What all words have in common says nothing: take the mean direction away.
    seen = np.abs(vectors).sum(axis=1) > 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if seen.any():
        vectors[seen] -= vectors[seen].mean(axis=0)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32)


def pooled(lists: pa.ListArray, vectors: np.ndarray) -> np.ndarray:
    """Means of word vectors, of shape vectors, and spreads of word vectors, per document; zeros without words."""
    word, shape, owner = _unpacked(lists)
    out = np.zeros((len(lists), 3 * DIMENSIONS))
    for start in range(0, len(word), CHUNK):
        o = owner[start:start + CHUNK]
        heads = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        v = vectors[word[start:start + CHUNK]]
        for part, values in enumerate((v, vectors[shape[start:start + CHUNK]], v * v)):
            out[o[heads], part * DIMENSIONS:(part + 1) * DIMENSIONS] += np.add.reduceat(values, heads, axis=0, dtype=np.float64)
    out /= np.maximum(np.bincount(owner, minlength=len(lists)), 1)[:, None]
    mean, spread = out[:, :DIMENSIONS], out[:, 2 * DIMENSIONS:]
    spread[:] = np.sqrt(np.maximum(spread - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers over standardised features; logits are divided by a temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 80, seed: int = 7) -> Network:
    """Adam on log loss over four fifths of the rows; the temperature minimises log loss on the rest.

    Without both classes the network is constant, with the share of class 1 (or one half without rows).
    """
    width = 3 * DIMENSIONS
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        flat.b2 = float(np.log(share / (1 - share)))
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at:at + 128]
            z = (x[rows] - net.center) / net.scale
            h = np.tanh(z @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40)))
            d = (p - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    logits, target = net.logits(x[held]), y[held]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - target * logits / t)
    if len(held):
        net.temperature = float(min(np.exp(np.linspace(-2, 3, 101)), key=loss))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def in_held_out(doc_id: Column) -> Column:
    """One fifth of the ids, which no label is learned from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vectors from all documents; the network from labelled rows that are not held out, ``sample_rows`` at most.

    The sample holds the ids of least hash, so it is the same in every run. Ids labelled twice count with their lower label.
    """
    vectors = word_vectors(docs, text)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    sample = (
        usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    # At most sample_rows ids and labels: a bounded table, small enough for every task.
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    labelled = own.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "_label", tokens_of(F.col("_text")).alias("tokens"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_label", "x"])

    rows = labelled.mapInArrow(features, "_id bigint, _label int, x binary").orderBy(F.xxhash64("_id"), "_id", "x").limit(sample_rows).collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), 3 * DIMENSIONS)
    return QualityModel(vectors, fit_network(x, np.array([r["_label"] for r in rows], dtype=np.float64)))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with a score from 0 to 1, higher for likelier good text.

    The text is all that is looked at. Null, empty and blank texts get the score of a text without words. Very long
    texts are pooled in pieces of bounded size. Equal texts get equal scores; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(tokens: pa.Array) -> pa.Array:
        return pa.array(shared.value.network.scores(pooled(tokens, shared.value.vectors)))

    score.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    tokened = with_once(docs, "_qu_tokens", tokens_of(F.col(text)))
    return tokened.withColumn(name, F.arrow_udf(score, DoubleType())("_qu_tokens")).drop("_qu_tokens")

"""Benchmark items in training text: BM25 with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from plotweave.llm.common import text_of, words_of
from plotweave.plans.once import with_once

#: BM25 constants.
K1, B = 1.2, 0.75
#: A passage is two strides of words; it starts at every stride. At least this long, longer for longer items.
STRIDE = 64
#: Share of an item's own score that a passage has to reach, and share of 3-word windows of question and of answer it has to hold.
THRESHOLD = 0.6
OVERLAP = 0.6
#: Items of one index; more items make more indexes, each with its own pass.
INDEX_ITEMS = 20_000
#: Items whose largest contributions a block keeps.
BLOCK_ITEMS = 16

HIT = StructType([StructField("item_id", LongType()), StructField("score", DoubleType()),
                  StructField("question", DoubleType()), StructField("answer", DoubleType())])


def terms_of(text: Column) -> Column:
    """Hashed words, lower case, without signs."""
    return F.transform(words_of(F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}\p{N}\s]+", "")), lambda w: F.xxhash64(w))


def _windows(terms: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of ``n`` terms in a row."""
    if len(terms) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = terms.view(np.uint64)
        h = np.zeros(len(x) - n + 1, dtype=np.uint64)
        for i in range(n):
            h = (h ^ x[i:len(x) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return np.unique(h)


def _part(terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Windows of three terms of a question or an answer (of all terms, if fewer), and their length."""
    n = max(1, min(3, len(terms)))
    return _windows(terms, n), n


@dataclass
class Index:
    """Impact-ordered postings of some items. Impacts are shares of the item's own score, so all items share one threshold."""

    terms: np.ndarray  # sorted term hashes
    heads: np.ndarray  # where each term's postings start
    items: np.ndarray
    impacts: np.ndarray
    block_heads: np.ndarray  # where each term's blocks start
    blocks: np.ndarray
    block_most: np.ndarray  # largest impact of the term in the block
    essential: np.ndarray  # terms of which every passage over the threshold has one
    stride: int
    ids: np.ndarray
    parts: list = field(default_factory=list)  # per item: windows of question and of answer, each with the length of a window


def build_index(ids: np.ndarray, questions: list[np.ndarray], answers: list[np.ndarray], idf: dict[int, float],
                mean_length: float, threshold: float) -> Index:
    """An index of items given as hashed terms. Items are ordered by their rarest term, so that blocks hold like items."""
    whole = [np.concatenate(x) for x in zip(questions, answers)]
    order = sorted(range(len(ids)), key=lambda i: (min(((-idf[t], t) for t in whole[i].tolist()), default=(0.0, 0)), int(ids[i])))
    postings: list[tuple[int, int, float]] = []
    essential: set[int] = set()
    for place, i in enumerate(order):
        found, counts = np.unique(whole[i], return_counts=True)
        weight = np.array([idf[t] for t in found.tolist()])
        impact = weight * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(whole[i]) / mean_length))
        impact = impact / impact.sum() if len(impact) else impact
        postings += [(t, place, v) for t, v in zip(found.tolist(), impact.tolist())]
        # The weakest terms that together stay below the threshold cannot bring a passage over it.
        rising = np.argsort(impact, kind="stable")
        strong = np.cumsum(impact[rising]) >= threshold
        essential.update(found[rising[strong]].tolist())
    postings.sort()
    term = np.array([p[0] for p in postings], dtype=np.int64)
    item = np.array([p[1] for p in postings], dtype=np.int64)
    impact = np.array([p[2] for p in postings])
    terms, heads = np.unique(term, return_index=True)
    pair = np.searchsorted(terms, term) * (len(ids) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    block_pair, block_at = np.unique(pair, return_index=True)
    most = np.maximum.reduceat(impact, block_at) if len(pair) else impact
    owner = block_pair // (len(ids) // BLOCK_ITEMS + 1)
    return Index(
        terms, np.append(heads, len(term)), item, impact, np.searchsorted(owner, np.arange(len(terms) + 1)),
        block_pair % (len(ids) // BLOCK_ITEMS + 1), most, np.isin(terms, np.array(sorted(essential), dtype=np.int64)),
        max([STRIDE, *map(len, whole)]), np.asarray(ids)[order], [(_part(questions[i]), _part(answers[i])) for i in order])


def _expand(heads: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``of``: its number, once per element of its list, and the places of those elements."""
    n = heads[of + 1] - heads[of]
    source = np.repeat(np.arange(len(of)), n)
    return source, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads[of], n)


def search(index: Index, terms: np.ndarray, owner: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """All (passage start, row, item, score) over the threshold, for the words of some rows.

    Bounds are taken away step by step, as in WAND: passages without an essential term are left out;
    then blocks of items whose largest contributions, summed over the passage's terms, stay below the
    threshold; what is left is scored item by item.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0),)
    if not len(terms) or not len(index.terms):
        return none
    at = np.minimum(np.searchsorted(index.terms, terms), len(index.terms) - 1)
    known = index.terms[at] == terms
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(terms)) - np.repeat(first, np.diff(np.append(first, len(terms))))
    # Strides are numbered over the batch with one left free after every row, so that passages stay within rows.
    strides = place[np.append(first[1:], len(terms)) - 1] // index.stride + 2
    base = np.repeat(np.cumsum(strides) - strides, np.diff(np.append(first, len(terms))))
    stride = base + place // index.stride
    total = int(strides.sum()) + 1
    alive = np.zeros(total + 1, dtype=bool)
    alive[stride[known & index.essential[at]]] = True
    passage_alive = alive[:-1] | alive[1:]  # passage p is strides p and p + 1
    stride, at = stride[known], at[known]
    parts = []
    for shift in (0, 1):
        p = stride - shift
        use = (p >= 0) & passage_alive[np.maximum(p, 0)]
        parts.append(p[use] * len(index.terms) + at[use])
    pairs = np.unique(np.concatenate(parts))
    if not len(pairs):
        return none
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    starts, passage = np.unique(passage, return_inverse=True)
    n_blocks = int(index.blocks.max()) + 1
    source, where = _expand(index.block_heads, term)
    bound = np.bincount(passage[source] * n_blocks + index.blocks[where], index.block_most[where], minlength=len(starts) * n_blocks)
    open_block = bound >= threshold - 1e-9
    some = open_block.reshape(len(starts), n_blocks).any(axis=1)[passage]
    passage, term = passage[some], term[some]
    source, where = _expand(index.heads, term)
    fine = open_block[passage[source] * n_blocks + index.items[where] // BLOCK_ITEMS]
    source, where = source[fine], where[fine]
    keys, inverse = np.unique(passage[source] * len(index.ids) + index.items[where], return_inverse=True)
    score = np.bincount(inverse, index.impacts[where], minlength=len(keys))
    over = score >= threshold - 1e-9
    keys, score = keys[over], score[over]
    row_base = np.cumsum(strides) - strides
    row = np.searchsorted(row_base, starts[keys // len(index.ids)], side="right") - 1
    begin = first[row] + np.maximum(starts[keys // len(index.ids)] - row_base[row], 0) * index.stride
    return begin, owner[first[row]], keys % len(index.ids), score


def _verified(index: Index, terms: np.ndarray, owner: np.ndarray, threshold: float, overlap: float) -> dict:
    """Per (row, item) the best score and overlaps of question and answer, of passages that hold enough of both."""
    found: dict = {}
    for begin, row, item, score in zip(*search(index, terms, owner, threshold)):
        piece = terms[begin:begin + 2 * index.stride]
        piece = piece[owner[begin:begin + 2 * index.stride] == row]
        shares = [float(np.isin(part, _windows(piece, n)).mean()) if len(part) else 1.0 for part, n in index.parts[item]]
        if min(shares) >= overlap:
            best = found.get((row, item))
            if best is None or score > best[0]:
                found[row, item] = (float(score), *shares)
    return found


def item_parts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, question, answer`` as hashed terms: the last sentence is the answer, of a single sentence its last third."""
    whole = F.trim(text_of(F.col(text)))
    head = F.regexp_extract(whole, r"(?s)^(.*[.?!])\s+(.+)$", 1)
    tail = F.regexp_extract(whole, r"(?s)^(.*[.?!])\s+(.+)$", 2)
    one = terms_of(whole)
    split = items.select(F.col(item_id).cast("bigint").alias("item_id"), terms_of(head).alias("q"), terms_of(tail).alias("a"), one.alias("t"))
    cut = F.ceil(F.size("t") * 2 / 3).cast("int")
    single = (F.size("q") == 0) | (F.size("a") == 0)
    return split.select(
        "item_id", F.when(single, F.slice("t", 1, cut)).otherwise(F.col("q")).alias("question"),
        F.when(single, F.slice("t", cut + 1, F.size("t"))).otherwise(F.col("a")).alias("answer")
    ).where(F.col("item_id").isNotNull() & (F.size("question") > 0))


def indexes_of(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD,
               index_items: int = INDEX_ITEMS) -> list[Index]:
    """Indexes of all items, ``index_items`` in each, so that what a task holds is bounded however many items there are.

    Document frequencies and mean length are of all items, counted in Spark.
    """
    parts = item_parts(items, item_id, text)
    term = parts.select("item_id", F.explode(F.concat("question", "answer")).alias("t"))
    totals = parts.agg(F.count("*").alias("n"), F.avg(F.size("question") + F.size("answer")).alias("mean")).first()
    shards = -(-totals["n"] // index_items)
    built = []
    for shard in range(shards):
        own = parts.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        rows = own.orderBy("item_id", "question", "answer").collect()
        mine = own.select(F.explode(F.concat("question", "answer")).alias("t")).distinct()
        df = {r["t"]: r["n"] for r in term.distinct().join(mine, "t").groupBy("t").agg(F.count("*").alias("n")).collect()}
        idf = {t: float(np.log(1 + (totals["n"] - n + 0.5) / (n + 0.5))) for t, n in df.items()}
        as_terms = lambda c: [np.array(r[c], dtype=np.int64) for r in rows]  # noqa: B023, E731
        built.append(build_index(np.array([r["item_id"] for r in rows], dtype=np.int64), as_terms("question"), as_terms("answer"),
                                 idf, totals["mean"], threshold))
    return built


def with_hits(docs: DataFrame, indexes: list[Index], text: str = "text", name: str = "hits",
              threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """All rows and columns with the benchmark items found in them: ``array<struct<item_id, score, question, answer>>``.

    ``score`` is the BM25 score of the best passage as a share of the item's own. Every passage of every whole text is a query.
    Null, empty and blank texts have no hits; equal texts have equal hits; items without a word or an id are left
    out; without items nothing is hit. An empty table stays empty.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(i) for i in indexes]

    def find(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy()
        terms = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
        out: list[list[dict]] = [[] for _ in range(len(lists))]
        for index in (s.value for s in shared):
            for (row, item), (score, question, answer) in sorted(_verified(index, terms, owner, threshold, overlap).items()):
                out[row].append({"item_id": int(index.ids[item]), "score": score, "question": question, "answer": answer})
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])))

    find.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    termed = with_once(docs, "_dc_terms", terms_of(F.col(text)))
    return termed.withColumn(name, F.arrow_udf(find, ArrayType(HIT))("_dc_terms")).drop("_dc_terms")

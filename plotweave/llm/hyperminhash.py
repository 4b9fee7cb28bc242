"""Near-duplicates by HyperMinHash: compressed registers, banded, estimated, then verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged, words_of
from plotweave.llm.components import components
from plotweave.plans.skew import salted_join

REGISTERS = 128
MANTISSA_BITS = 10
#: Standard errors by which an estimate may fall short of the threshold before a pair is passed over.
MARGIN = 5.0
#: Members of a bucket that are compared as one block; larger buckets are compared block by block.
BLOCK = 512
#: Members of a star that one task compares with its centre before they are dealt to several.
HOT_CENTRE = 10_000


def shingles_of(text: Column, k: int) -> Column:
    """Distinct hashes of ``k`` successive words, A-Z in lower case; fewer words are one shingle, none give none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashes = F.transform(words_of(lower), lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(k)]))
    sets = lambda h: F.when(F.size(h) >= k, F.array_distinct(windows(h))).when(
        F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    # A one-row array names the hashed words, so that they are made once.
    return F.element_at(F.transform(F.array(hashes), sets), 1)


def registers_of(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers (rows x REGISTERS, uint16; 0 is empty) of hashed shingles.

    The low bits choose the bucket. Of the smallest remaining number in it a register keeps the count of leading zeros,
    plus one, and the bits after the leading one. Equal shingles in a bucket give equal registers.
    """
    bits = int(np.log2(REGISTERS))
    width = 64 - bits
    bucket = (values & np.uint64(REGISTERS - 1)).astype(np.int64)
    least = np.full(rows * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, owner * REGISTERS + bucket, values >> np.uint64(bits))
    filled = least != np.iinfo(np.uint64).max
    number = np.maximum(least[filled], np.uint64(1 << MANTISSA_BITS))
    top = np.floor(np.log2(number.astype(np.float64))).astype(np.int64)
    top -= (number >> top.astype(np.uint64)) == 0  # a number just below a power of two rounds up
    zeros = width - 1 - top
    mantissa = (number >> (top - MANTISSA_BITS).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = np.zeros(rows * REGISTERS, dtype=np.uint16)
    out[filled] = ((zeros + 1) << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    return out.reshape(rows, REGISTERS)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of every set, two fingerprints of it and its registers."""
    for batch in batches:
        sets = batch.column("_set")
        offsets = sets.offsets.to_numpy()
        sizes = np.diff(offsets).astype(np.int64)
        values = sets.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            sums = [np.zeros(len(sizes), dtype=np.uint64) for _ in range(2)]
            np.add.at(sums[0], owner, mixed)
            np.add.at(sums[1], owner, (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        sketches = registers_of(values, owner, len(sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
             pa.array([row.tobytes() for row in sketches], pa.binary())],
            ["doc_id", "n_shingles", "f1", "f2", "sketch"])


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and the number of registers they rest on.

    Registers that agree, less those expected to agree by chance (Yu and Weber's approximation for large sets),
    over registers filled in either sketch.
    """
    either = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    agree = ((a == b) & (a != 0)).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739093975315012348 * 2.0 ** -MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(agree - chance * either, 0) / either, either


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False where sizes or estimates rule a link out."""
    share = percent / 100
    estimate, filled = estimated_jaccard(a, b, n, m)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (
        estimate >= share - MARGIN * np.sqrt(share * (1 - share) / filled))


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(-1, REGISTERS)


def _kept_pairs(percent: int):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                fine = may_link(_matrix(x["sa"]), _matrix(x["sb"]), x["na"].to_numpy(), x["nb"].to_numpy(), percent)
                yield x.loc[fine, ["a", "b"]]
    return keep


class Unions:
    """Components met in one task, merged as links between them turn up."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def merge(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links that join what was apart: a forest, however many links there are."""
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            s, t = self.top(x), self.top(y)
            if s != t:
                self.up[max(s, t)] = min(s, t)
                new.append((x, y))
        return new


def _by_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in order of (grp, p, q), cut so that no run of equal keys is torn; runs are of bounded length."""
    held: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        key = x[["grp", "p", "q"]].to_numpy()
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        if held and (held[-1][["grp", "p", "q"]].to_numpy()[-1] != key[0]).any():
            yield pd.concat(held)
            held = []
        if len(other):
            yield pd.concat([*held, x.iloc[:other[-1] + 1]])
            held = []
        held.append(x.iloc[other[-1] + 1:] if len(other) else x)
    if held:
        yield pd.concat(held)


def _runs(x: pd.DataFrame) -> np.ndarray:
    key = x[["grp", "p", "q"]].to_numpy()
    return np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])


def _likely_links(percent: int):
    """Links between components that the sketches of two members within a run do not rule out, as a forest."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Unions()
        for x in _by_run(batches):
            run, new = _runs(x), []
            comp, n, block = (x[c].to_numpy() for c in ("component", "n", "block"))
            same_block = (x["p"] == x["q"]).to_numpy()
            regs = _matrix(x["payload"])
            for lag in range(1, np.bincount(run).max()):
                i = np.flatnonzero(run[:-lag] == run[lag:])
                i = i[(comp[i] != comp[i + lag]) & (same_block[i] | (block[i] != block[i + lag]))]
                fine = i[may_link(regs[i], regs[i + lag], n[i], n[i + lag], percent)]
                new += seen.merge(comp[fine], comp[fine + lag])
            yield pd.DataFrame(new, columns=["a", "b"], dtype=np.int64)
    return scan


def _exact_links(percent: int):
    """Links between components that full sets within a run prove, as a forest."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Unions()
        for x in _by_run(batches):
            run, new = _runs(x), []
            for r in range(1, run[-1] + 1):
                one = x.iloc[np.searchsorted(run, r):np.searchsorted(run, r, side="right")]
                comp, block, sets = one["component"].to_numpy(), one["block"].to_numpy(), one["payload"].to_list()
                n = np.array([len(s) for s in sets])
                codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
                at = np.r_[0, np.cumsum(n)]
                flag = np.zeros(codes.max() + 1, dtype=np.int64)
                both = one["p"].iloc[0] == one["q"].iloc[0]
                for i in range(len(sets) - 1):
                    flag[codes[at[i]:at[i + 1]]] = 1
                    common = np.add.reduceat(flag[codes[at[i + 1]:]], at[i + 1:-1] - at[i + 1])
                    flag[codes[at[i]:at[i + 1]]] = 0
                    j = np.arange(i + 1, len(sets))
                    fine = (100 * common >= percent * (n[i] + n[j] - common)) & (comp[j] != comp[i])
                    fine &= both | (block[j] != block[i])
                    new += seen.merge(np.full(fine.sum(), comp[i]), comp[j[fine]])
            yield pd.DataFrame(new, columns=["a", "b"], dtype=np.int64)
    return scan


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of groups (``grp, id, component, n``) dealt to pairs of blocks in which every two members of different
    components meet once: adds ``block, p, q``. Groups with one component are left out.

    The largest component of a group has blocks of its own, which meet only blocks of the rest. So what a large group
    of linked copies costs is its size times the number of blocks of those not linked yet.
    """
    of = members.groupBy("grp", "component").agg(F.count("*").alias("_n"))
    groups = of.groupBy("grp").agg(
        F.sum("_n").alias("_all"), F.max(F.struct("_n", "component")).alias("_most"), F.count("*").alias("_components")
    ).where("_components > 1").select(
        "grp", F.col("_most.component").alias("_main"), F.ceil(F.col("_most._n") / BLOCK).cast("int").alias("_main_blocks"),
        F.ceil((F.col("_all") - F.col("_most._n")) / BLOCK).cast("int").alias("_blocks"))
    main = F.col("component") == F.col("_main")
    own = F.pmod(F.xxhash64("id"), F.when(main, F.col("_main_blocks")).otherwise(F.col("_blocks"))).cast("int")
    placed = members.join(groups, "grp").withColumn("block", F.when(main, -1 - own).otherwise(own))
    # Blocks of the main component have numbers below zero; pairs are (lower, higher), the higher never below zero.
    partners = F.when(main, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(
        F.concat(F.sequence(F.lit(0), F.col("_blocks") - 1), F.transform(F.sequence(F.lit(0), F.col("_main_blocks") - 1), lambda i: -1 - i)))
    return placed.withColumn("_other", F.explode(partners)).select(
        "grp", F.least("block", "_other").alias("p"), F.greatest("block", "_other").alias("q"), "block", "id", "component", "n")


def _linked(dealt: DataFrame, find) -> DataFrame:
    """Links between components found by ``find`` in every pair of blocks."""
    ready = dealt.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q")
    return ready.mapInPandas(find, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; the row to keep of a component is its smallest id.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.

    1. Every set gets a sketch (:func:`registers_of`). Rows with equal sets form a class; only classes go on.
    2. Registers are banded: 32 bands of 4, for 8 to 63 shingles 16 of 8. At the threshold a pair of
       large sets misses all bands with probability (1 - 0.8^4)^32 = 5e-8; small sets differ in fewer shingles than there
       are bands. Sets of different band width meet because a set close below 64 (or 8) shingles is banded both ways.
    3. Each class is compared with the smallest class of its buckets that it meets most often. Verified links
       give first components; a large group of copies is one star, not all its pairs.
    4. Where a bucket still holds different components, sketches across them are compared, in blocks of bounded size.
       What they do not rule out joins components to neighbourhoods; only a forest of such links leaves a task.
    5. Within each neighbourhood full sets across components are intersected, in blocks again, and proven links merge the components.
       So no link between two components is passed over, and no task or table holds all pairs of a group.

    Verification intersects the full sets, made again from whole texts; the estimate only rules out.

    Null and blank texts have no shingles and are linked with nothing. Rows without an id are linked with
    nothing and kept. Rows that repeat an id are one node. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    shingled = source.withColumn("_set", shingles_of(F.col("_text"), k))
    rows = staged(shingled.select("doc_id", "_set").mapInArrow(
        _sketched, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch binary"), "sketches")
    classes = staged(
        rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "classes")

    n = F.col("n_shingles")
    own = F.when(n.between(8, 63), F.lit(8)).otherwise(F.lit(4))
    near = F.when(n.between(6, 7), F.lit(8)).when(n.between(51, 63), F.lit(4)).otherwise(own)
    bands = classes.select("id", n.alias("n"), "sketch", F.explode(F.array_distinct(F.array(own, near))).alias("width")).withColumn(
        "band", F.explode(F.sequence(F.lit(0), (F.lit(REGISTERS) / F.col("width")).cast("int") - 1)))
    keyed = bands.withColumn("_part", F.expr("substring(sketch, band * width * 2 + 1, width * 2)")).where(
        F.ltrim(F.hex("_part"), F.lit("0")) != "").select("id", "n", F.xxhash64("width", "band", "_part").alias("bucket"))

    buckets = staged(keyed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("first")).where("members > 1"), "buckets")
    met = keyed.join(buckets, "bucket").where("id <> first").groupBy("id", "first").agg(F.count("*").alias("times"))
    stars = met.groupBy(F.col("id").alias("b")).agg(F.max_by("first", F.struct("times", -F.col("first"))).alias("a")).select("a", "b")
    linked = _verified_stars(stars, classes, source, k, percent)
    named = classes.select("id", F.col("n_shingles").alias("n")).join(components(linked), F.col("id") == F.col("node"), "left").select(
        "id", "n", F.coalesce("component", "id").alias("component"))
    named = staged(named, "named")

    crowded = keyed.join(buckets, "bucket").join(named.drop("n"), "id").select(F.col("bucket").alias("grp"), "id", "component", "n")
    sketches = classes.select("id", F.col("sketch").alias("payload"))
    likely = _linked(_in_blocks(staged(crowded, "crowded")).join(sketches, "id"), _likely_links(percent))
    around = components(likely).select(F.col("node").alias("component"), F.col("component").alias("grp"))
    near = staged(_in_blocks(staged(named.join(around, "component"), "near")), "blocks")
    ids = staged(near.select(F.col("id").alias("doc_id"), "n").distinct(), "ids")
    # The comparison holds for all rows; with one Spark filters the texts by a Bloom filter of the ids before it shuffles them.
    sets = source.join(ids.where("n > 0"), "doc_id").select(F.col("doc_id").alias("id"), shingles_of(F.col("_text"), k).alias("payload"))
    merged = components(_linked(near.join(sets, "id"), _exact_links(percent)))
    final = named.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_merged")), "component", "left").select(
        F.col("id").alias("node"), F.coalesce("_merged", "component").alias("component")).distinct()

    of_class = classes.join(final, classes["id"] == final["node"], "left").select(
        "n_shingles", "f1", "f2", F.coalesce("component", "id").alias("_component"))
    both = rows.drop("sketch").join(of_class, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return both.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _verified_stars(stars: DataFrame, classes: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """Of links ``(a, b)`` from centres a to one b each, those whose full sets are similar enough."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    likely = staged(stars.join(side("a"), "a").join(side("b"), "b").mapInPandas(_kept_pairs(percent), "a bigint, b bigint"), "stars")
    members = staged(likely.select(F.col("b").alias("doc_id"), F.col("a").alias("centre")).union(
        likely.select(F.col("a").alias("doc_id"), F.col("a").alias("centre")).distinct()), "members")
    # A centre is the smallest id of its star. As above, the comparison lets Spark filter texts by ids before the shuffle.
    sets = staged(source.join(members.where("centre <= doc_id"), "doc_id").select(
        "doc_id", "centre", shingles_of(F.col("_text"), k).alias("set")), "sets")
    centres = sets.where("doc_id = centre").select("centre", F.col("set").alias("_centre_set"))
    common = F.size(F.array_intersect("set", "_centre_set"))
    return staged(
        salted_join(sets.where("doc_id <> centre"), centres, ["centre"], ["doc_id"], HOT_CENTRE)
        .withColumn("_common", common)
        .where(100 * F.col("_common") >= percent * (F.size("set") + F.size("_centre_set") - F.col("_common")))
        .select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), "verified")

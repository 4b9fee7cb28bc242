"""A content-addressed manifest of a table, and proofs that a row belongs to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import staged
from plotweave.llm.spans import named

#: Children of a node, and the bits of a rank that choose one.
FAN_OUT, DIGIT = 16, 4
PATH = "array<struct<before:string,after:string>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def counted(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return digest_of(*[counted(f) for f in fields])


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the order, in two tables that meet in (keys, ``_part``).

    Sorted ranges of (keys, order) are written with the number of the range (``_part``) and of the row (``_no``). The second table has one row
    for each (keys, range): ``_base``, to be added to ``_no`` for the rank from 0 within the keys, and ``_n``, rows of the keys.
    A key of any size spreads over ranges. Rows equal in keys and order come in any order.
    """
    by = [*keys, *order, "_tie"]
    sorted_ranges = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = staged(sorted_ranges.select(
        *rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_no")), "ranked")
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_no").alias("_from"))
    return placed, ranges.select(
        *keys, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_from")).alias("_base"), F.sum("_rows").over(every).alias("_n"))


@dataclass(frozen=True)
class Manifest:
    """Trees of all groups and the tree of their roots.

    ``groups``: ``tree, key, subroot, depth``, one row per group. ``records`` and ``top_records``: by height from 1, ``tree, pos, size, digest, members``, a
    node per row; ``members`` are its children in order, ``struct<pos, digest>`` and at height 1 also the payload. ``lone``: the leaves of groups
    of one row, which have no node. ``root``: ``tree, pos, digest``, one row.
    """

    groups: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    lone: DataFrame
    root: DataFrame


def _levels(nodes: DataFrame, depth: int, payload: Sequence[str] = ()) -> list[DataFrame]:
    """Nodes above ``nodes (tree, pos, size, digest)``, one table for each height; ``size`` is the number of nodes of the tree at that height."""
    heights = []
    for height in range(depth):
        member = F.struct("pos", "digest", *payload) if height == 0 else F.struct("pos", "digest")
        runs = nodes.where("size > 1").groupBy("tree", F.shiftright("pos", DIGIT).alias("_run")).agg(
            F.sort_array(F.collect_list(member)).alias("members"), F.first("size").alias("size"))
        nodes = staged(runs.select(
            "tree", F.col("_run").alias("pos"), F.shiftright(F.col("size") + (FAN_OUT - 1), DIGIT).alias("size"),
            digest_of(F.array_join(F.transform("members", lambda m: m["digest"]), "")).alias("digest"), "members"), "nodes")
        heights.append(nodes)
    return heights


def _depth(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN_OUT), depth + 1
    return depth


def build_manifest(leaves: DataFrame, key: str, order: Sequence[str], digest: str = "leaf") -> Manifest:
    """A tree of the leaves of every ``key``, in the given order, and a tree of their roots, by key (null first, bytewise).

    While several nodes of a tree remain, every 16 in a row become the digest of their digests. Other columns of ``leaves`` are the payload.
    Ties in the order come in the order of the digest; equal leaves are interchangeable. No leaves give no groups and no root.

    Groups may be of any size and number: leaves are ranked by sorted ranges, a node gathers 16 rows, and only the size of the largest group and the
    number of groups reach the driver.
    """
    own = [c for c in leaves.columns if c not in (key, digest)]
    rows = staged(leaves.select(F.col(key).alias("_key"), F.col(digest).alias("digest"), *own), "leaves")
    placed, ranges = ranked(rows, ["_key"], [*order, "digest"])
    ranges = staged(ranges, "ranges")
    keys, key_ranges = ranked(staged(ranges.groupBy("_key").agg(F.first("_n").alias("size")), "keys"), [], ["_key"])
    groups = staged(keys.join(key_ranges.drop("_n"), "_part").select("_key", "size", (F.col("_no") + F.col("_base")).alias("tree")), "groups")
    numbers = groups.select(F.col("_key").alias("_k"), "tree")
    known = ranges.join(numbers, ranges["_key"].eqNullSafe(numbers["_k"])).select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_base", F.col("_n").alias("size"), "tree")
    nodes = placed.join(known, placed["_key"].eqNullSafe(known["_k"]) & (placed["_part"] == known["_p"])).select(
        "tree", (F.col("_no") + F.col("_base")).alias("pos"), "size", "digest", *own)

    largest, count = groups.agg(F.max("size"), F.count("*")).first()
    records = _levels(nodes, _depth(largest or 0), own)
    lone = staged(nodes.where("size = 1"), "lone")
    roots = lone.select("tree", "digest", F.lit(0).alias("depth"))
    for height, level in enumerate(records, 1):
        roots = roots.union(level.where("size = 1").select("tree", "digest", F.lit(height)))
    named_roots = staged(groups.join(roots, "tree").select("tree", F.col("_key").alias("key"), F.col("digest").alias("subroot"), "depth"), "subroots")
    tops = named_roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("bigint").alias("size"),
                              F.col("subroot").alias("digest"))
    top_records = _levels(tops, _depth(count))
    root = (top_records[-1] if top_records else tops).select("tree", "pos", "digest")
    return Manifest(named_roots, records, top_records, lone, root)


def _digests(record: Column) -> Column:
    return F.transform(record, lambda m: m["digest"])


def _others(children: Column, digit: Column) -> Column:
    """What stands before and after the chosen child of a run."""
    return F.struct(F.array_join(F.slice(children, 1, digit), "").alias("before"),
                    F.array_join(F.slice(children, digit + 2, F.lit(FAN_OUT)), "").alias("after"))


def _children_by_digest(level: DataFrame) -> DataFrame:
    """The content-addressed records of a height: ``_digest`` to ``_children``. Equal nodes share one."""
    return level.select(F.col("digest").alias("_digest"), _digests(F.col("members")).alias("_children")).dropDuplicates(["_digest"])


def _step_down(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """From nodes to their children: the record of a digest is looked up, each child goes on and the others join its path."""
    records = _children_by_digest(level)
    opened = frontier.join(records, frontier["digest"] == records["_digest"]).select(
        *frontier.columns, "_children", F.explode(F.sequence(F.lit(0), F.size("_children") - 1)).alias("_digit"))
    carried = [c for c in frontier.columns if c not in ("pos", "digest", "path")]
    return opened.select(
        *carried, (F.col("pos") * FAN_OUT + F.col("_digit")).alias("pos"), F.get("_children", F.col("_digit")).alias("digest"),
        F.concat(F.array(_others(F.col("_children"), F.col("_digit"))), F.col("path")).alias("path"))


def proofs(manifest: Manifest, requests: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """For every requested leaf ``tree, pos, digest``, its payload, ``key, subroot, root`` and its ``path`` to the root, leaf end first.

    Requests descend from the root by the digits of their ranks. Those that agree in the digits so far travel as one row, so the record of a node is
    looked up once, whatever number of leaves lie below it; every step puts the children not taken in front of the path, which thus
    ends up in the order of proofs. ``path`` holds for each level what stands before and after the node in its run.

    ``requests`` (a column ``by``, one of the payload) asks for some of the leaves; by default all are asked for. Requests that match no leaf give no row.
    """
    top, root = manifest.top_records, F.col("root")
    asked = [lv for lv in manifest.records[:1]]
    bottom = asked[0].select("tree", "pos", F.col("members").alias("_asked")) if asked else None
    lone = manifest.lone
    wanted_trees = None
    if requests is not None:
        ids = requests.select(F.col(by).alias("_by")).distinct()
        lone = lone.join(ids, lone[by] == ids["_by"], "left_semi")
        if bottom is not None:
            single = bottom.select("tree", "pos", F.explode("_asked").alias("m"))
            bottom = staged(single.join(ids, single[f"m.{by}"] == ids["_by"]).groupBy("tree", "pos").agg(F.collect_list("m").alias("_asked")), "asked")
        wanted_trees = lone.select("tree")
        if bottom is not None:
            wanted_trees = wanted_trees.union(bottom.select("tree")).distinct()

    def pruned(frontier: DataFrame, wanted: DataFrame | None, digits: int) -> DataFrame:
        """Only prefixes of ranks that are asked for; ``digits`` of them are still to come."""
        if wanted is None:
            return frontier
        prefixes = wanted.select("tree", F.shiftright("pos", DIGIT * digits).alias("pos")).distinct()
        return frontier.join(prefixes, ["tree", "pos"], "left_semi")

    frontier = manifest.root.select(F.lit(0).cast("bigint").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "digest",
                                    F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    top_ranks = None if wanted_trees is None else wanted_trees.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"))
    for height in range(len(top), 0, -1):
        frontier = pruned(_step_down(frontier, top[height - 1]), top_ranks, height - 1)
    known = manifest.groups.select(F.col("tree").alias("_tree"), "key", "subroot", "depth")
    frontier = staged(frontier.join(known, frontier["pos"] == known["_tree"]).select(
        F.col("_tree").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "digest", root, "key", "subroot", "depth", "path"), "frontier")
    alone = frontier.where("depth = 0").drop("pos", "digest", "depth")
    found = lone.drop("size").join(alone, "tree")
    columns = found.columns
    if bottom is None:
        return found
    for height in range(len(manifest.records), 1, -1):
        opened = pruned(_step_down(frontier.where(F.col("depth") == height), manifest.records[height - 1]), bottom, height - 2)
        frontier = staged(frontier.where(F.col("depth") < height).unionByName(opened.withColumn("depth", F.lit(height - 1))), "frontier")
    records = _children_by_digest(manifest.records[0])
    runs = frontier.where("depth = 1").join(bottom, ["tree", "pos"])
    runs = runs.join(records, runs["digest"] == records["_digest"]).withColumn("_m", F.explode("_asked"))
    digit = (F.col("_m.pos") - F.col("pos") * FAN_OUT).cast("int")
    payload = [F.col(f"_m.{c}").alias(c) for c in lone.columns if c not in ("tree", "pos", "size", "digest")]
    return found.unionByName(runs.select(
        "tree", F.col("_m.pos").alias("pos"), F.get("_children", digit).alias("digest"), *payload, "root", "key", "subroot",
        F.concat(F.array(_others(F.col("_children"), digit)), F.col("path")).alias("path")).select(*columns))


def proof_digest(path: Column) -> Column:
    """Digest of the siblings, level by level from the leaf, left to right."""
    return digest_of(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, x: digest_of(x["before"], h, x["after"]))

"""Rings put in order: which lies in which, and polygons rebuilt from rings that cross."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators import geometry
from plotweave.operators.geometry import PAIRS_AT_ONCE, geometry_validity, repaired_ring

Point = tuple[float, float]
RING = "array<struct<x:double,y:double>>"
#: Rounds of cutting edges at their crossings; crossings are rounded to doubles, which may make edges cross once more.
CUTTING_ROUNDS = 5


def _edges(ring: np.ndarray) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of a ring of vertices; an open ring is closed."""
    edges = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
    return edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


# --- which ring lies in which ----------------------------------------------------------------------


def ring_groups(rings: list[np.ndarray]) -> list[list[int]]:
    """Polygons as lists of ring numbers, the shell first, in the order of their shells.

    The depth of a ring is the number of larger rings it lies in. Rings of even depth are shells; one of odd depth is a hole of the smallest shell it
    lies in. The direction of rings plays no part. Only rings whose box lies in the other's are compared, all of them with a ring at once. A
    ring lies in another if the first of its vertices and edge middles that is not on it is inside; equal rings do not lie in each other.
    """
    rings = [np.asarray(r, dtype=float).reshape(-1, 2) for r in rings]
    used = [i for i, r in enumerate(rings) if len(r)]
    if len(used) < 2:
        return [[i] for i in used]
    areas = np.array([abs(_area(rings[i])) for i in used])
    low, high = np.array([rings[i].min(0) for i in used]), np.array([rings[i].max(0) for i in used])
    around: list[list[int]] = [[] for _ in used]
    starts = np.array([rings[i][0] for i in used])
    for j, i in enumerate(used):
        within = np.flatnonzero((low >= low[j]).all(1) & (high <= high[j]).all(1) & (areas < areas[j]))
        if not len(within):
            continue
        edges = _edges(rings[i])
        sides = geometry._place(edges, starts[within])
        for k, side in zip(within, sides):
            if side == 0:
                other = rings[used[k]]
                more = geometry._place(edges, np.concatenate([other, (other + np.roll(other, -1, axis=0)) / 2]))
                side = next((s for s in more if s), -1)
            if side > 0:
                around[k].append(j)
    depth = [len(a) for a in around]
    groups: dict[int, list[int]] = {j: [used[j]] for j in range(len(used)) if depth[j] % 2 == 0}
    for k, outer in enumerate(around):
        if depth[k] % 2:
            shells = [j for j in outer if depth[j] % 2 == 0]
            groups[min(shells, key=lambda j: areas[j])].append(used[k])
    return list(groups.values())


def _rings_of(polygons: pa.Array) -> Iterator[list[np.ndarray]]:
    """Vertices of the rings of each polygon, from Arrow lists of lists of (x, y)."""
    per_polygon = pa.compute.fill_null(pa.compute.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(int)
    all_rings = polygons.flatten()
    per_ring = pa.compute.fill_null(pa.compute.list_value_length(all_rings), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = all_rings.flatten()
    vertices = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
    ends, first = np.concatenate([[0], np.cumsum(per_ring)]), np.concatenate([[0], np.cumsum(per_polygon)])
    for a, b in zip(first[:-1], first[1:]):
        yield [vertices[ends[k]:ends[k + 1]] for k in range(a, b)]


def nested_rings(rings: Column) -> Column:
    """:func:`ring_groups` of an array of rings of ``struct<x, y>``, as an array of arrays of ring numbers; empty rings are left out."""

    def group(polygons: pa.Array) -> pa.Array:
        return pa.array([ring_groups(own) for own in _rings_of(polygons)], pa.list_(pa.list_(pa.int32())))

    for module in (sys.modules[__name__], geometry):
        cloudpickle.register_pickle_by_value(module)
    group.__annotations__ = {"polygons": pa.Array, "return": pa.Array}
    return F.arrow_udf(group, "array<array<int>>").asNondeterministic()(rings)


# --- rebuilding ------------------------------------------------------------------------------------


def _close_pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges that may share more than the end they have in common."""
    size = np.abs(edges).max() + 1
    for a, b in geometry.box_pairs(np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])):

        def clear(p, q):
            """All of q on one side of p, beyond what rounding could hide; or touching it with one end at an end of p."""
            x1, y1, x2, y2 = edges[p].T
            turn = [(x2 - x1) * (edges[q, i + 1] - y1) - (y2 - y1) * (edges[q, i] - x1) for i in (0, 2)]
            doubt = 1e-12 * size * (np.abs(x2 - x1) + np.abs(y2 - y1))
            ends = [np.minimum(np.abs(edges[q, i] - edges[p, j]), 1) + np.minimum(np.abs(edges[q, i + 1] - edges[p, j + 1]), 1) == 0 for i in (0, 2) for j in (0, 2)]
            shared = [ends[0] | ends[1], ends[2] | ends[3]]
            beyond = [np.abs(t) > doubt for t in turn]
            return (beyond[0] & beyond[1] & (turn[0] * turn[1] > 0)) | (shared[0] & beyond[1]) | (shared[1] & beyond[0])

        left = ~(clear(a, b) | clear(b, a))
        yield a[left], b[left]


def _common_points(a: np.ndarray, b: np.ndarray) -> list[Point]:
    """Points where two edges meet, worked out exactly and then rounded; the ends of what they share if they overlap."""
    px, py, qx, qy, cx, cy, dx, dy = (Fraction(float(v)) for v in (*a, *b))
    rx, ry, sx, sy = qx - px, qy - py, dx - cx, dy - cy
    cross, offset = rx * sy - ry * sx, (cx - px) * ry - (cy - py) * rx
    if cross:
        t, u = ((cx - px) * sy - (cy - py) * sx) / cross, offset / cross
        return [(float(px + t * rx), float(py + t * ry))] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if offset:
        return []
    along = lambda x, y, x1, y1, x2, y2: min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
    found = [(float(x), float(y)) for x, y in ((cx, cy), (dx, dy)) if along(x, y, px, py, qx, qy)]
    return found + [(float(x), float(y)) for x, y in ((px, py), (qx, qy)) if along(x, y, cx, cy, dx, dy)]


def _noded(edges: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges cut wherever two of them meet."""
    for _ in range(CUTTING_ROUNDS):
        cuts: dict[int, set[Point]] = {}
        for first, second in _close_pairs(edges):
            for a, b in zip(first.tolist(), second.tolist()):
                for point in _common_points(edges[a], edges[b]):
                    for e in (a, b):
                        if point not in ((edges[e, 0], edges[e, 1]), (edges[e, 2], edges[e, 3])):
                            cuts.setdefault(e, set()).add(point)
        if not cuts:
            break
        pieces, owners = [np.delete(edges, list(cuts), axis=0)], [np.delete(owner, list(cuts))]
        for e, points in cuts.items():
            x1, y1, x2, y2 = edges[e].tolist()
            path = [(x1, y1), *sorted(points, key=lambda p: (p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)), (x2, y2)]
            pieces.append(np.array([(*p, *q) for p, q in zip(path, path[1:])]))
            owners.append(np.full(len(path) - 1, owner[e]))
        edges, owner = np.concatenate(pieces), np.concatenate(owners)
    return edges, owner


def _windings(pieces: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers of a ring to the left and right of each piece. Pieces run upwards, or to the right; the ring runs ``net`` times along each."""
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    flat = pieces[:, 1] == pieces[:, 3]
    own = np.flatnonzero((net != 0) & ~flat)
    x1, y1, x2, y2 = pieces[own].T
    above, below = np.zeros(len(pieces), dtype=int), np.zeros(len(pieces), dtype=int)
    step = max(1, PAIRS_AT_ONCE // max(len(own), 1))
    for start in range(0, len(pieces), step):
        rows = np.arange(start, min(start + step, len(pieces)))
        x, y = mid[rows, 0][:, None], mid[rows, 1][:, None]
        beyond = (x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x) & (own[None, :] != rows[:, None])
        above[rows] = (beyond & (y1 <= y) & (y < y2)) @ net[own]
        below[rows] = (beyond & (y1 < y) & (y <= y2)) @ net[own]
    return np.where(flat, above, above + net), np.where(flat, below, above)


def _loops(borders: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Simple rings of directed border edges that have the inside on their left."""
    leaving: dict[Point, list[tuple[float, Point]]] = {}
    for p, q in borders:
        leaving.setdefault(p, []).append((math.atan2(q[1] - p[1], q[0] - p[0]), q))
    for ends in leaving.values():
        ends.sort()
    loops = []
    for start in list(leaving):
        while leaving[start]:
            at, path, seen = start, [start], {start: 0}
            angle = None
            while True:
                ends = leaving[at]
                # The inside lies clockwise of the way back, up to the next border.
                pick = len(ends) - 1 if angle is None else next((i for i in range(len(ends) - 1, -1, -1) if ends[i][0] < angle), len(ends) - 1)
                direction, to = ends.pop(pick)
                angle = direction - math.pi if direction > 0 else direction + math.pi
                at = to
                if at in seen:
                    loops.append(path[seen[at]:])
                    for gone in path[seen[at] + 1:]:
                        del seen[gone]
                    del path[seen[at] + 1:]
                    if at == start:
                        break
                else:
                    seen[at] = len(path)
                    path.append(at)
    return loops


def rebuilt(rings: list[np.ndarray]) -> list[list[list[Point]]]:
    """Valid polygons of the area that a shell goes round and no hole does; each a list of closed rings, the shell first and counterclockwise.

    The first ring is the shell, the others are holes; what a ring winds around counts, in either direction and however often. Edges are cut where
    they meet; of the pieces those stay that have the area on one side only, and they are followed from node to node. Parts that touch in
    a point are polygons of their own. Without area there are none.
    """
    parts = [_edges(np.asarray(r, dtype=float).reshape(-1, 2)) for r in rings]
    if not parts or not len(parts[0]):
        return []
    edges, owner = _noded(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
    forward = (edges[:, 1] < edges[:, 3]) | ((edges[:, 1] == edges[:, 3]) & (edges[:, 0] < edges[:, 2]))
    upward = np.where(forward[:, None], edges, edges[:, [2, 3, 0, 1]])
    pieces, of = np.unique(upward, axis=0, return_inverse=True)
    of = of.reshape(-1)
    left = right = None
    for ring in range(len(parts)):
        net = np.bincount(of[owner == ring], weights=np.where(forward[owner == ring], 1, -1), minlength=len(pieces)).astype(int)
        if ring and not net.any():
            continue
        sides = [w != 0 for w in _windings(pieces, net)]
        left, right = (sides[0], sides[1]) if ring == 0 else (left & ~sides[0], right & ~sides[1])
    ends = [(tuple(p[:2]), tuple(p[2:])) for p in pieces.tolist()]
    borders = [(p, q) if inner else (q, p) for (p, q), inner, outer in zip(ends, left, right) if inner != outer]
    loops = [np.array(loop) for loop in _loops(borders) if len(loop) > 2]
    loops = [loop for loop in loops if _area(loop)]
    closed = lambda loop: [tuple(p) for p in [*loop.tolist(), loop[0].tolist()]]
    return [[closed(loops[i]) for i in group] for group in ring_groups(loops)]


def geometry_rebuild(polygons: DataFrame) -> DataFrame:
    """Polygons with ``parts``, an array of valid polygons (rings, the shell first), and ``was_valid``.

    Rings are closed and freed of repeated vertices first. What is valid then is its own only part; everything else is rebuilt from its
    edges by :func:`rebuilt`. Polygons without rings or without area have no parts. A polygon is worked on in one task.
    """
    shell_first = F.expr("transform(filter(rings, (r, i) -> i = 0 OR size(r) > 0), r -> coalesce(r, array()))").cast(f"array<{RING}>")
    closed = F.transform(shell_first, lambda r: F.when(F.size(r) > 0, repaired_ring(r)).otherwise(r))
    tried = geometry_validity(polygons.withColumn("_given", F.col("rings")).withColumn("rings", closed))

    def rebuild(broken: pa.Array) -> pa.Array:
        found = [[[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in rebuilt(own)] if own else [] for own in _rings_of(broken)]
        vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return pa.array(found, pa.list_(pa.list_(pa.list_(vertex))))

    for module in (sys.modules[__name__], geometry):
        cloudpickle.register_pickle_by_value(module)
    rebuild.__annotations__ = {"broken": pa.Array, "return": pa.Array}
    broken = F.when(~F.col("is_valid"), F.coalesce("rings", F.array().cast(f"array<{RING}>"))).otherwise(F.slice("rings", 1, 0))
    made = tried.withColumn("_made", F.arrow_udf(rebuild, f"array<array<{RING}>>").asNondeterministic()(broken))
    return made.withColumn("parts", F.when(F.col("is_valid"), F.array("rings")).otherwise(F.col("_made"))).withColumn("rings", F.col("_given")).select(
        *polygons.columns, "parts", F.col("is_valid").alias("was_valid"))


def parts_area(parts: Column) -> Column:
    """Area of polygons: shells less holes."""
    size = lambda r: F.abs(geometry.ring_signed_area(r))
    of = lambda p: F.aggregate(p, F.lit(0.0), lambda t, r: t - size(r), lambda t: t + 2 * size(F.get(p, F.lit(0))))
    return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda t, a: t + a)

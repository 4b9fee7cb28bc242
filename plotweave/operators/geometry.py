"""Validity, simple repair and queries on polygons and sheets."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from plotweave.functions.geometry import ring_edges, ring_signed_area, rings_bbox
from plotweave.operators.zones import zone_lookup
from plotweave.plans.picking import priority_pick
from plotweave.plans.skew import HOT_ROWS
from plotweave.plans.spatial_join import point_in_box, point_in_polygon, radius_join

#: Largest number of edges whose pairs are compared inside the JVM; longer rings are swept.
PAIRWISE_EDGES = 16
#: Edge pairs a sweep holds in memory.
PAIRS_AT_ONCE = 1_000_000
#: Points of similar height that are placed in a ring at once.
POINTS_AT_ONCE = 256


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _segments_meet(a: Column, b: Column) -> Column:
    """Two segments share a point: they cross, touch or overlap."""
    boxes = (
        (F.least(a.x1, a.x2) <= F.greatest(b.x1, b.x2)) & (F.least(b.x1, b.x2) <= F.greatest(a.x1, a.x2))
        & (F.least(a.y1, a.y2) <= F.greatest(b.y1, b.y2)) & (F.least(b.y1, b.y2) <= F.greatest(a.y1, a.y2))
    )
    d1 = _side(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1) * _side(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
    d2 = _side(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1) * _side(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)
    return boxes & (d1 <= 0) & (d2 <= 0)


def _neighbours_fold(a: Column, b: Column) -> Column:
    """``b`` starts where ``a`` ends and runs back over it."""
    collinear = (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) == 0
    back = (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1) < 0
    return collinear & back


def _distinct_edges(ring: Column) -> Column:
    """Edges of a ring without zero-length ones, numbered."""
    real = F.filter(ring_edges(ring), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))
    return F.transform(
        real, lambda e, i: F.struct(i.alias("i"), e.x1.alias("x1"), e.y1.alias("y1"), e.x2.alias("x2"), e.y2.alias("y2"))
    )


def _crosses_itself(edges: Column) -> Column:
    n = F.size(edges)

    def meets_any(a: Column) -> Column:
        def bad(b: Column) -> Column:
            gap = b.i - a.i
            adjacent = (gap == 1) | (gap == n - 1)
            forward = F.when(gap == 1, _neighbours_fold(a, b)).otherwise(_neighbours_fold(b, a))
            return (gap > 0) & F.when(adjacent, forward).otherwise(_segments_meet(a, b))

        return F.exists(edges, bad)

    return F.exists(edges, meets_any)


def sweep_self_contact(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> bool:
    """Same test as the pairwise one for long rings: only edges overlapping in x and y are compared.

    Edges are sorted by their left end, so the partners of an edge follow it without gaps. Pairs are
    built and tested as arrays, a bounded number at a time.
    """
    n = len(x1)
    if n < 2:
        return False
    lo_x, hi_x = np.minimum(x1, x2), np.maximum(x1, x2)
    lo_y, hi_y = np.minimum(y1, y2), np.maximum(y1, y2)
    order = np.argsort(lo_x, kind="stable")
    partners = np.searchsorted(lo_x[order], hi_x[order], side="right") - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(partners)])

    def side(e: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return np.sign((x2[e] - x1[e]) * (py - y1[e]) - (y2[e] - y1[e]) * (px - x1[e]))

    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS_AT_ONCE, side="right")) - 1)
        ranks = np.repeat(np.arange(start, stop), partners[start:stop])
        step = np.arange(len(ranks)) - np.repeat(total[start:stop] - total[start], partners[start:stop])
        a, b = order[ranks], order[ranks + 1 + step]
        overlap = (lo_y[b] <= hi_y[a]) & (lo_y[a] <= hi_y[b])
        a, b = a[overlap], b[overlap]
        gap = np.abs(a - b)
        adjacent = (gap == 1) | (gap == n - 1)
        cross = (x2[a] - x1[a]) * (y2[b] - y1[b]) - (y2[a] - y1[a]) * (x2[b] - x1[b])
        dot = (x2[a] - x1[a]) * (x2[b] - x1[b]) + (y2[a] - y1[a]) * (y2[b] - y1[b])
        folded = adjacent & (cross == 0) & (dot < 0)
        met = (
            ~adjacent
            & (side(a, x1[b], y1[b]) * side(a, x2[b], y2[b]) <= 0)
            & (side(b, x1[a], y1[a]) * side(b, x2[a], y2[a]) <= 0)
        )
        if (folded | met).any():
            return True
        start = stop
    return False


def _long_ring_contact(rings: Column) -> Column:
    """Does one of the (long) rings of a polygon touch itself? Works on Arrow arrays of edges."""

    def contact(polygons: pa.Array) -> pa.Array:
        per_polygon = pa.compute.fill_null(pa.compute.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)
        all_rings = polygons.flatten()
        bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(all_rings).to_numpy(zero_copy_only=False))]).astype(int)
        edges = all_rings.flatten()
        x1, y1, x2, y2 = (edges.field(name).to_numpy(zero_copy_only=False) for name in ("x1", "y1", "x2", "y2"))
        touching = np.array([
            sweep_self_contact(x1[a:b], y1[a:b], x2[a:b], y2[a:b]) for a, b in zip(bounds[:-1], bounds[1:])
        ], dtype=bool)
        owner = np.repeat(np.arange(len(polygons)), per_polygon)
        found = np.zeros(len(polygons), dtype=bool)
        found[owner[touching]] = True
        return pa.array(found)

    # The code travels with the job, so executors need no copy of this package. Marked as not
    # deterministic, so that filters on the result do not make Spark evaluate it once more.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    contact.__annotations__ = {"polygons": pa.Array, "return": pa.Array}
    return F.arrow_udf(contact, BooleanType()).asNondeterministic()(rings)


def _sides(ax, ay, bx, by, px, py) -> np.ndarray:
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _place(edges: np.ndarray, points: np.ndarray) -> np.ndarray:
    """1 for points inside a ring, 0 on it, -1 outside (even-odd rule).

    Points are taken in groups of similar height, and each group meets only edges that reach its heights.
    """
    out = np.empty(len(points), dtype=int)
    order = np.argsort(points[:, 1], kind="stable")
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    start = 0
    while start < len(points):
        rows = order[start:start + POINTS_AT_ONCE]
        near = edges[(low <= points[rows[-1], 1]) & (high >= points[rows[0], 1])]
        rows = rows[:max(1, PAIRS_AT_ONCE // max(len(near), 1))]
        x1, y1, x2, y2 = (near[:, i][None, :] for i in range(4))
        px, py = points[rows, 0][:, None], points[rows, 1][:, None]
        side = _sides(x1, y1, x2, y2, px, py)
        on = (side == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
        crossed = ((y1 > py) != (y2 > py)) & (side == np.where(y2 > y1, 1, -1))
        out[rows] = np.where(on.any(axis=1), 0, np.where(crossed.sum(axis=1) % 2 == 1, 1, -1))
        start += len(rows)
    return out


def _edges_conflict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges of ``a`` cross, or run along, the one of ``b`` beside them? Touching in single points is allowed."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a.T, b.T
    s1, s2 = _sides(ax1, ay1, ax2, ay2, bx1, by1), _sides(ax1, ay1, ax2, ay2, bx2, by2)
    cross = (s1 * s2 < 0) & (_sides(bx1, by1, bx2, by2, ax1, ay1) * _sides(bx1, by1, bx2, by2, ax2, ay2) < 0)
    shared_x = np.minimum(np.maximum(ax1, ax2), np.maximum(bx1, bx2)) - np.maximum(np.minimum(ax1, ax2), np.minimum(bx1, bx2))
    shared_y = np.minimum(np.maximum(ay1, ay2), np.maximum(by1, by2)) - np.maximum(np.minimum(ay1, ay2), np.minimum(by1, by2))
    along = (s1 == 0) & (s2 == 0) & (shared_x >= 0) & (shared_y >= 0) & (shared_x + shared_y > 0)
    return cross | along


def box_pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes (lower and upper corners) that meet, each once.

    Boxes are sorted by their left ends, so those that a box meets in x follow it without gaps. A bounded number of pairs is made at a time.
    """
    order = np.argsort(low[:, 0], kind="stable")
    partners = np.searchsorted(low[order, 0], high[order, 0], side="right") - np.arange(len(low)) - 1
    total, start = np.concatenate([[0], np.cumsum(partners)]), 0
    while start < len(low):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS_AT_ONCE, side="right")) - 1)
        ranks = np.repeat(np.arange(start, stop), partners[start:stop])
        step = np.arange(len(ranks)) - np.repeat(total[start:stop] - total[start], partners[start:stop])
        a, b = order[ranks], order[ranks + 1 + step]
        meet = (low[b, 1] <= high[a, 1]) & (low[a, 1] <= high[b, 1])
        yield a[meet], b[meet]
        start = stop


def rings_conflict(rings: list[np.ndarray]) -> str | None:
    """What is wrong between the rings of a polygon, given as edges (x1, y1, x2, y2); the first is the shell.

    The first hole at fault decides, and of its faults the first in this order: it crosses an earlier ring, leaves the shell, overlaps an earlier hole.
    Edges of all rings meet in one sweep, and only holes whose boxes overlap are compared, so the work follows the number of
    edges and not the pairs of holes.
    """
    faults: list[tuple[int, int]] = []  # number of the hole, and of the reason
    edges, owner = np.concatenate(rings), np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    crossing = len(rings)
    for a, b in box_pairs(np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])):
        later = np.maximum(owner[a], owner[b])
        a, b = (x[(owner[a] != owner[b]) & (later < crossing)] for x in (a, b))
        bad = _edges_conflict(edges[a], edges[b])
        if bad.any():
            crossing = int(np.maximum(owner[a], owner[b])[bad].min())
    faults.append((crossing, 0))
    held = owner > 0
    outside = owner[held][_place(rings[0], edges[held, :2]) < 0]
    faults.append((int(outside.min()) if len(outside) else len(rings), 1))
    first = min(faults)[0]
    boxes = [np.array([f(r[:, :2], 0) for r in rings[1:]]).reshape(-1, 2) for f in (np.min, np.max)]
    overlapping = []
    for a, b in box_pairs(*boxes):
        inner = ((boxes[0][a] < boxes[1][b]) & (boxes[0][b] < boxes[1][a])).all(1) & (np.maximum(a, b) + 1 < first)
        overlapping.append(np.stack([np.maximum(a, b)[inner], np.minimum(a, b)[inner]], axis=1) + 1)
    for j, i in sorted(map(tuple, np.concatenate(overlapping).tolist())) if overlapping else ():
        if (_place(rings[i], rings[j][:, :2]) > 0).any() or (_place(rings[j], rings[i][:, :2]) > 0).any():
            faults.append((j, 2))
            break
    hole, reason = min(faults)
    return ("rings cross", "hole outside shell", "holes overlap")[reason] if hole < len(rings) else None


def _rings_against_each_other(rings: Column) -> Column:
    """Reason of conflict between the rings of polygons with holes; others send an empty array."""

    def judge(polygons: pa.Array) -> pa.Array:
        counts = pa.compute.fill_null(pa.compute.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(int)
        all_rings = polygons.flatten()
        bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(all_rings).to_numpy(zero_copy_only=False))]).astype(int)
        edges = all_rings.flatten()
        table = np.stack([edges.field(name).to_numpy(zero_copy_only=False) for name in ("x1", "y1", "x2", "y2")], axis=1)
        first, found = np.concatenate([[0], np.cumsum(counts)]), []
        for a, b in zip(first[:-1], first[1:]):
            own = [table[bounds[k]:bounds[k + 1]] for k in range(a, b)]
            found.append(rings_conflict(own) if len(own) > 1 and all(map(len, own)) else None)
        return pa.array(found, pa.string())

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    judge.__annotations__ = {"polygons": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, StringType()).asNondeterministic()(rings)


def geometry_validity(polygons: DataFrame, long_rings: bool = True) -> DataFrame:
    """Polygons with ``is_valid`` and the first broken rule as ``reason``.

    Rules, in order: has rings; four vertices per ring; closed; area; no ring touches itself; rings neither cross
    nor run along each other, holes lie inside the shell and outside each other. Rings may touch in single points. Short
    rings are tested against themselves in the JVM, long ones by a sweep in Arrow batches, as are polygons with
    holes; all are exact. ``long_rings=False`` leaves out the sweep where rings are known to be short.
    """
    rings = F.col("rings")
    checked = polygons.withColumn("_edges", F.transform(rings, _distinct_edges))
    contact = F.exists("_edges", lambda e: (F.size(e) <= PAIRWISE_EDGES) & _crosses_itself(e))
    # Polygons with nothing to test in Arrow send an empty array there; both tests share one pass.
    tests = {"_conflict": _rings_against_each_other(F.when(F.size(rings) > 1, F.col("_edges")).otherwise(F.slice("_edges", 1, 0)))}
    if long_rings:
        tests["_contact"] = _long_ring_contact(F.filter("_edges", lambda e: F.size(e) > PAIRWISE_EDGES))
        contact = contact | F.col("_contact")
    checked = checked.withColumns(tests)
    reason = (
        F.when(rings.isNull() | (F.size(rings) == 0), "empty")
        .when(F.exists(rings, lambda r: F.size(r) < 4), "too few vertices")
        .when(F.exists(rings, lambda r: (r[0].x != F.element_at(r, -1).x) | (r[0].y != F.element_at(r, -1).y)), "not closed")
        .when(F.exists(rings, lambda r: ring_signed_area(r) == 0), "no area")
        .when(contact, "ring touches itself")
        .otherwise(F.col("_conflict"))
    )
    return checked.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).select(
        *polygons.columns, "is_valid", "reason"
    )


def invalid_geometry_count(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("total"), F.count_if(~F.col("is_valid")).alias("invalid"))


def repaired_ring(ring: Column) -> Column:
    """Ring without repeated neighbours, closed."""
    kept = F.filter(ring, lambda v, i: (i == 0) | (v.x != F.get(ring, i - 1).x) | (v.y != F.get(ring, i - 1).y))
    first, last = kept[0], F.element_at(kept, -1)
    open_ring = (first.x != last.x) | (first.y != last.y)
    return F.when(open_ring, F.concat(kept, F.array(first))).otherwise(kept)


def geometry_basic_repair(polygons: DataFrame) -> DataFrame:
    """Polygons after simple repair with ``is_valid`` and ``reason``; those it cannot mend keep their rings.

    Repair closes rings, drops repeated vertices and drops rings that are empty or have no area left. One result for
    both, so that a caller who splits it may write it once first.
    """
    filled = F.filter("rings", lambda r: F.size(r) > 0)
    mended = F.filter(
        F.transform(filled, repaired_ring), lambda r: (F.size(r) >= 4) & (ring_signed_area(r) != 0)
    )
    tried = geometry_validity(polygons.withColumn("_original", F.col("rings")).withColumn("rings", mended))
    kept = F.when(F.col("is_valid"), F.col("rings")).otherwise(F.col("_original"))
    return tried.withColumn("rings", kept).select(*polygons.columns, "is_valid", "reason")


# --- joins -----------------------------------------------------------------------------------------

#: Frame handles in the order in which they win.
HANDLES = ("top_left", "top_right", "bottom_right", "bottom_left")
BODY = "body"


def frame_anchors(frames: DataFrame) -> DataFrame:
    """Corner points of frames (``frame_id`` and eight corner columns ``<corner>_x, <corner>_y``)."""
    corner = lambda i, name: F.struct(
        F.lit(i).alias("priority"), F.lit(name).alias("handle"), F.col(f"{name}_x").alias("ax"), F.col(f"{name}_y").alias("ay")
    )
    return frames.select("frame_id", F.inline(F.array(*[corner(i, n) for i, n in enumerate(HANDLES)])))


def frame_polygons(frames: DataFrame) -> DataFrame:
    vertex = lambda n: F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y"))
    return frames.select(F.col("frame_id").alias("poly_id"), F.array(F.array(*[vertex(n) for n in HANDLES])).alias("rings"))


def nearest_anchor(points: DataFrame, frames: DataFrame, radius: float = 12.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a point hits in each frame: a corner within the radius, else the body; no row if neither.

    Corners win by their fixed order, not by distance. Each (point, frame) has at most five candidates.
    """
    corners = radius_join(points, frame_anchors(frames), radius, hot_rows).select("pt_id", "frame_id", "priority", "handle")
    bodies = point_in_polygon(points, frame_polygons(frames), hot_rows).select(
        "pt_id", F.col("poly_id").alias("frame_id"), F.lit(len(HANDLES)).alias("priority"), F.lit(BODY).alias("handle")
    )
    return priority_pick(corners.unionByName(bodies), ["pt_id", "frame_id"], ["priority"]).drop("priority")


#: Handles of an upright rectangle after its corners, as fractions of width and height.
RECT_HANDLES = {
    "top_left": (0.0, 0.0), "top_right": (1.0, 0.0), "bottom_right": (1.0, 1.0), "bottom_left": (0.0, 1.0),
    "left": (0.0, 0.5), "right": (1.0, 0.5), "top": (0.5, 0.0), "bottom": (0.5, 1.0),
}


def nearest_rect_handle(points: DataFrame, rects: DataFrame, radius: float = 12.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As :func:`nearest_anchor` for upright rectangles (``frame_id, left, top, width, height``).

    Corners win over the middles of the sides, and these over the body, whose edges all count as inside.
    """
    handles = F.array(*[
        F.struct(
            F.lit(i).alias("priority"), F.lit(name).alias("handle"),
            (F.col("left") + F.col("width") * fx).alias("ax"), (F.col("top") + F.col("height") * fy).alias("ay"),
        )
        for i, (name, (fx, fy)) in enumerate(RECT_HANDLES.items())
    ])
    anchors = rects.select("frame_id", F.inline(handles))
    near = radius_join(points, anchors, radius, hot_rows).select("pt_id", "frame_id", "priority", "handle")
    box = F.struct(
        F.col("left").alias("min_x"), F.col("top").alias("min_y"),
        (F.col("left") + F.col("width")).alias("max_x"), (F.col("top") + F.col("height")).alias("max_y"),
    )
    bodies = point_in_box(points, rects.select("frame_id", box.alias("_box")), hot_rows).select(
        "pt_id", "frame_id", F.lit(len(RECT_HANDLES)).alias("priority"), F.lit(BODY).alias("handle")
    )
    return priority_pick(near.unionByName(bodies), ["pt_id", "frame_id"], ["priority"]).drop("priority")


def feature_at_click(points: DataFrame, polygons: DataFrame, zones: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Zone information of the polygons under each point."""
    return zone_lookup(point_in_polygon(points, polygons, hot_rows), zones)


def layer_extent(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounding box over all polygons of a group."""
    boxed = polygons.withColumn("_box", rings_bbox(F.col("rings")))
    return boxed.groupBy(*by).agg(
        F.min("_box.min_x").alias("min_x"), F.min("_box.min_y").alias("min_y"),
        F.max("_box.max_x").alias("max_x"), F.max("_box.max_y").alias("max_y"),
    )

"""Point-in-polygon and radius joins as equi-joins on grid cells.

Catalyst would plan a geometric predicate as a nested loop. Both sides get a cell key instead;
the exact test runs on the few pairs that share a cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.geometry import edge_crossed, inside_edges, point_distance, polygon_edges, rings_bbox
from plotweave.plans.once import with_once
from plotweave.plans.ordered import number_segment, ordered_lag
from plotweave.plans.skew import HOT_ROWS, salted_join


#: Edges a polygon may have before it is cut into pieces, and edges of a piece that are aimed at.
WHOLE_EDGES, PIECE_EDGES = 16, 4
#: Levels that a shape may lie above the finer grid and still be dealt over its cells, and cells a shape may cover on average.
LEVELS_ABOVE, CELLS_PER_SHAPE = 5, 8
#: Cells of a long polygon that an edge of average size crosses in each direction, and columns of a block in which crossings are added up.
CELLS_PER_EDGE, BLOCK_COLS = 2, 1024
#: Edges of one polygon that a task lays on the polygon's grid.
EDGES_PER_TASK = 200_000

PIECE = """array<struct<row:int,col:int,odd:boolean,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>>>"""


def _level(side: Column) -> Column:
    """The grid whose cells are as large as the side, or up to twice as large."""
    return F.ceil(F.log2(F.greatest(side, F.lit(1e-9)))).cast("int")


def two_levels(shapes: DataFrame) -> Column:
    """The two grids in use, as a subquery: an array of one or two levels, null without shapes.

    ``shapes`` has ``_level`` (grid of the shape's size) and ``_shapes`` (how many there are). A shape of the finer grid is at most ``LEVELS_ABOVE``
    above it; what is larger uses the coarser grid. Each is the finest that most of its shapes suit and in which its shapes cover no more than
    ``CELLS_PER_SHAPE`` times 4 cells for every shape there is. So both the copies of points (two) and of shapes are bounded, whatever the sizes.
    """
    sizes = shapes.groupBy("_level").agg(F.sum("_shapes").alias("n")).agg(F.expr("sort_array(collect_list(struct(_level AS l, CAST(n AS DOUBLE) AS n))) AS h"))
    total = "aggregate({0}, 0D, (t, x) -> t + x.n)"
    cells = "aggregate({0}, 0D, (t, x) -> t + x.n * pow(4D, greatest(x.l - at, 0)))"
    near = f"filter(h, y -> y.l <= at + {LEVELS_ABOVE})"
    found = sizes.where("size(h) > 0").selectExpr("h", "sequence(h[0].l, element_at(h, -1).l) AS every", f"{CELLS_PER_SHAPE} * {total.format('h')} AS budget")
    fine = f"filter(every, at -> {CELLS_PER_SHAPE} * 2 * {total.format(near)} >= budget AND {cells.format(near)} <= budget)[0]"
    found = found.selectExpr("*", f"{fine} AS fine").selectExpr("*", f"filter(h, x -> x.l > fine + {LEVELS_ABOVE}) AS rest")
    coarse = f"filter(every, at -> at > fine AND {cells.format('rest')} <= budget)[0]"
    return found.selectExpr(f"IF(size(rest) > 0, array(fine, {coarse}), array(fine)) AS levels").scalar()


def _met(points: DataFrame, shapes: DataFrame, levels: Column, hot_rows: int) -> DataFrame:
    """Pairs of points and shapes (``_box``, ``_level``) of a common cell; every pair whose box holds the point is there once.

    A shape lives in one of the two grids and a point in one cell of each. Cells with many points are split.
    """
    cell = "CAST(floor({0} / pow(2D, _level)) AS BIGINT)"
    span = lambda v: f"explode(sequence({cell.format(f'_box.min_{v}')}, {cell.format(f'_box.max_{v}')})) AS _c{v}"
    placed = shapes.withColumn("_levels", levels).withColumn("_level", F.expr(f"IF(_level <= _levels[0] + {LEVELS_ABOVE}, _levels[0], element_at(_levels, -1))")).drop("_levels")
    covered = placed.selectExpr("*", span("x")).selectExpr("*", span("y"))
    keyed = points.withColumn("_levels", levels).selectExpr(*points.columns, "explode(_levels) AS _level").selectExpr(
        "*", f"{cell.format('x')} AS _cx", f"{cell.format('y')} AS _cy")
    return salted_join(keyed, covered, ["_level", "_cx", "_cy"], salt_by=["pt_id"], hot_rows=hot_rows).drop("_level", "_cx", "_cy")


def point_in_box(points: DataFrame, sized: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of points (``pt_id, x, y``) and the shapes whose ``_box`` holds them, edges included."""
    side = F.greatest(F.col("_box.max_x") - F.col("_box.min_x"), F.col("_box.max_y") - F.col("_box.min_y"))
    shapes = sized.where("_box.min_x IS NOT NULL AND _box.min_y IS NOT NULL").withColumn("_level", _level(side))
    pairs = _met(points, shapes, two_levels(shapes.withColumn("_shapes", F.lit(1))), hot_rows)
    in_box = F.col("x").between(F.col("_box.min_x"), F.col("_box.max_x")) & F.col("y").between(F.col("_box.min_y"), F.col("_box.max_y"))
    return pairs.where(in_box).drop("_box")


# --- polygons in pieces ----------------------------------------------------------------------------


def _gridded(polygons: DataFrame) -> DataFrame:
    """Polygons with ``_grid``: box, number of rows and columns of pieces and their height and width.

    A horizontal line meets about ``t`` edges of a polygon, t being the height of all edges over that of the polygon. With n edges, c
    columns and n / c rows a piece holds about 2c edges with an end in its row and t / c that pass through it, which is least at
    c = sqrt(t / 2): few edges for plain shapes, about sqrt(n) for the worst comb.
    """
    shaped = with_once(polygons, "_shape", F.struct(rings_bbox(F.col("rings")).alias("box"), polygon_edges(F.col("rings")).alias("edges")))
    sized = shaped.where("_shape.box.min_x IS NOT NULL AND _shape.box.min_y IS NOT NULL")
    cut = f"size(_shape.edges) > {WHOLE_EDGES} AND _shape.box.max_y > _shape.box.min_y AND _shape.box.max_x > _shape.box.min_x"
    passes = "aggregate(_shape.edges, 0D, (t, e) -> t + abs(e.y2 - e.y1)) / (_shape.box.max_y - _shape.box.min_y)"
    parted = with_once(sized, "_parts", F.expr(f"IF({cut}, greatest(CAST(floor(sqrt({passes} / 2)) AS INT), 1), 1)")).selectExpr(
        "*", f"IF({cut}, CAST(ceil(size(_shape.edges) / ({PIECE_EDGES} * _parts)) AS INT), 1) AS _rows")
    grid = F.expr("""struct(_shape.box.*, _rows AS rows, _parts AS cols,
        (_shape.box.max_y - _shape.box.min_y) / _rows AS h, (_shape.box.max_x - _shape.box.min_x) / _parts AS w)""")
    return with_once(parted, "_grid", grid).withColumn("_edges", F.col("_shape.edges")).drop("_shape", "_parts", "_rows")


def cut_polygon(edges: np.ndarray, grid: tuple) -> list[tuple[int, int, bool, np.ndarray]]:
    """Pieces ``(row, col, odd, edges)`` of a polygon given by edges (x1, y1, x2, y2); pieces that lie outside are left out.

    A point of a piece is inside when ``odd`` differs from the parity of the edges of the piece that a ray to the right meets. Edges that do not
    reach the row meet no such ray. Edges that pass through the whole row to the right of the piece meet all of them: they are counted in
    ``odd``. Left are those that reach the columns of the piece, and those to its right that end within the row.
    """
    min_x, min_y, _, _, rows, cols, h, w = grid
    row_of = lambda y: np.clip(np.floor((y - min_y) / h), 0, rows - 1).astype(np.int64)
    col_of = lambda x: np.clip(np.floor((x - min_x) / w), 0, cols - 1).astype(np.int64)
    edges = edges[edges[:, 1] != edges[:, 3]]
    upward = edges[:, 1] < edges[:, 3]
    bottom, top = np.where(upward, edges[:, 1], edges[:, 3]), np.where(upward, edges[:, 3], edges[:, 1])
    first, last = row_of(bottom), row_of(top)
    reach = last - first + 1
    at = np.repeat(np.arange(len(edges)), reach)
    row = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach) + first[at]
    passing = (row > first[at]) & (row < last[at])
    x1, y1, x2, y2 = edges[at].T
    # Where an edge runs within a row, with a little to spare on both sides against rounding.
    low, high = np.maximum(bottom[at], min_y + (row - 0.01) * h), np.minimum(top[at], min_y + (row + 1.01) * h)
    xa, xb = x1 + (x2 - x1) * ((low - y1) / (y2 - y1)), x1 + (x2 - x1) * ((high - y1) / (y2 - y1))
    spare = 0.01 * w + 1e-12 * (np.abs(x1) + np.abs(x2))
    left, right = col_of(np.minimum(xa, xb) - spare), col_of(np.maximum(xa, xb) + spare)
    left = np.where(passing, left, 0)

    counted = np.zeros((rows, cols + 1), dtype=np.int64)
    np.add.at(counted, (row[passing], left[passing]), 1)
    odd = (counted[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] % 2).astype(bool)

    wide = right - left + 1
    copy = np.repeat(np.arange(len(at)), wide)
    col = np.arange(len(copy)) - np.repeat(np.cumsum(wide) - wide, wide) + left[copy]
    key = row[copy] * cols + col
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    held = dict(zip(keys.tolist(), np.split(at[copy][order], starts[1:])))
    inside = np.flatnonzero(odd.ravel()).tolist()
    none = np.empty(0, dtype=np.int64)
    return [(k // cols, k % cols, bool(odd[k // cols, k % cols]), edges[held.get(k, none)]) for k in sorted(held.keys() | set(inside))]


def _cut(edges: Column, grid: Column) -> Column:
    """:func:`cut_polygon` on Arrow arrays. Polygons that stay whole send no edges and get an empty array."""

    def cut(polygons: pa.Array, grids: pa.Array) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(polygons), 0).to_numpy(zero_copy_only=False))]).astype(int)
        flat = polygons.flatten()
        table = np.stack([flat.field(name).to_numpy(zero_copy_only=False) for name in ("x1", "y1", "x2", "y2")], axis=1)
        counts, pieces, sizes, coordinates = [], [], [], []
        for a, b, g in zip(bounds[:-1], bounds[1:], grids):
            found = cut_polygon(table[a:b], tuple(g.as_py().values())) if b > a else []
            counts.append(len(found))
            pieces.extend(p[:3] for p in found)
            sizes.extend(len(p[3]) for p in found)
            coordinates.extend(p[3] for p in found)
        cells = np.concatenate(coordinates) if coordinates else np.empty((0, 4))
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        ends = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)], names=["x1", "y1", "x2", "y2"])
        of_piece = pa.ListArray.from_arrays(offsets(sizes), ends)
        row, col, odd = zip(*pieces) if pieces else ((), (), ())
        return pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays(
            [pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(odd, pa.bool_()), of_piece], names=["row", "col", "odd", "edges"]))

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cut.__annotations__ = {"polygons": pa.Array, "grids": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, PIECE).asNondeterministic()(edges, grid)


def polygon_pieces(gridded: DataFrame) -> DataFrame:
    """One row per piece of polygons with ``_grid``, as ``_piece``; ``_box`` holds every point that falls into it."""
    whole = "_grid.rows * _grid.cols = 1"
    sent = F.expr(f"IF({whole}, slice(_edges, 1, 0), _edges)")
    one = f"CAST(array(struct(0 AS row, 0 AS col, FALSE AS odd, _edges AS edges)) AS {PIECE})"
    each = gridded.withColumn("_cut", _cut(sent, F.col("_grid"))).withColumn("_piece", F.expr(f"explode(IF({whole}, {one}, _cut))")).drop("_cut", "_edges", "rings")
    low = lambda v, step, i: f"IF({whole}, _grid.min_{v}, _grid.min_{v} + _grid.{step} * (_piece.{i} - 0.01D)) AS min_{v}"
    high = lambda v, step, i: f"IF({whole}, _grid.max_{v}, _grid.min_{v} + _grid.{step} * (_piece.{i} + 1.01D)) AS max_{v}"
    ends = ", ".join(end(*of) for end in (low, high) for of in (("x", "w", "col"), ("y", "h", "row")))
    return each.withColumn("_box", F.expr(f"struct({ends})"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of points (``pt_id, x, y``) and the polygons (``poly_id, rings``) that hold them (even-odd rule).

    Polygons of many edges are cut into pieces, each with the few edges that matter in it, so neither a shuffle nor the ray cast of a point
    meets the edges of a whole polygon. A point falls into one piece of a polygon at most.
    """
    gridded = _gridded(polygons)
    side = F.greatest(F.col("_grid.w"), F.col("_grid.h"))
    levels = two_levels(gridded.select(_level(side).alias("_level"), (F.col("_grid.rows") * F.col("_grid.cols")).alias("_shapes")))
    pairs = _met(points, polygon_pieces(gridded).withColumn("_level", _level(side)), levels, hot_rows)
    place = lambda v, step, n: f"least(coalesce(CAST(floor(try_divide({v} - _grid.min_{v}, _grid.{step})) AS INT), 0), _grid.{n} - 1)"
    here = F.expr(
        "x BETWEEN _grid.min_x AND _grid.max_x AND y BETWEEN _grid.min_y AND _grid.max_y"
        f" AND {place('y', 'h', 'rows')} = _piece.row AND {place('x', 'w', 'cols')} = _piece.col")
    inside = inside_edges(F.col("_piece.edges"), F.col("x"), F.col("y")) != F.col("_piece.odd")
    return pairs.where(here & inside).drop("_grid", "_piece", "_box")


# --- polygons whose edges are rows ------------------------------------------------------------------


def edges_of_rings(vertices: DataFrame) -> DataFrame:
    """Edges (``poly_id, x1, y1, x2, y2``) of rings given as rows ``poly_id, ring_no, vertex_no, x, y``; open rings are closed. No ring is collected."""
    keys = ["poly_id", "ring_no"]
    ends = vertices.select(*keys, "vertex_no", F.struct("x", "y").alias("_v"))
    after = ordered_lag(ends, "_v", keys, ["vertex_no"], number_segment("vertex_no"), "_u").where(F.col("_u").isNotNull())
    closing = ends.groupBy(*keys).agg(F.max_by("_v", "vertex_no").alias("_u"), F.min_by("_v", "vertex_no").alias("_v"))
    both = after.select("poly_id", "_u", "_v").union(closing.select("poly_id", "_u", "_v"))
    return both.selectExpr("poly_id", "_u.x AS x1", "_u.y AS y1", "_v.x AS x2", "_v.y AS y2")


def _edge_grid(edges: DataFrame) -> DataFrame:
    """``poly_id, _box, _grid`` of polygons with an area. Cells are half as wide and high as the average edge, and columns or rows at most as many as edges need."""
    sums = edges.groupBy("poly_id").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("x2") - F.col("x1"))).alias("dx"), F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("dy"),
        *[end(F.col(f"{v}1")).alias(f"{name}_{v}") for v in "xy" for name, end in (("min", F.min), ("max", F.max))])
    parts = lambda v: f"greatest(least(CAST(floor({CELLS_PER_EDGE} * (max_{v} - min_{v}) * n / d{v}) AS BIGINT), CAST(ceil(n / {PIECE_EDGES}) AS BIGINT)), 1)"
    sized = sums.where("max_x > min_x AND max_y > min_y").selectExpr("*", f"{parts('x')} AS cols", f"{parts('y')} AS rows")
    return sized.selectExpr(
        "poly_id", "struct(min_x, min_y, max_x, max_y) AS _box",
        "struct(min_x, min_y, rows, cols, (max_y - min_y) / rows AS h, (max_x - min_x) / cols AS w) AS _grid")


def _place(value: str, v: str) -> str:
    step, n = {"x": ("w", "cols"), "y": ("h", "rows")}[v]
    return f"greatest(least(CAST(floor(({value} - _grid.min_{v}) / _grid.{step}) AS BIGINT), _grid.{n} - 1), 0)"


def _crossing(edge: Column, x: Column, y: Column) -> Column:
    """As :func:`edge_crossed`, but an edge that lies wholly to one side of ``x`` is never taken for one on the other by rounding."""
    straddles = (edge.y1 > y) != (edge.y2 > y)
    return F.coalesce(straddles & (x < _crossed_at(edge, y)), F.lit(False))


def _crossed_at(edge: Column, y: Column) -> Column:
    at = F.try_divide((edge.x1 - edge.x2) * (y - edge.y2), edge.y1 - edge.y2) + edge.x2
    return F.greatest(F.least(at, F.greatest(edge.x1, edge.x2)), F.least(edge.x1, edge.x2))


def point_in_edges(points: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As :func:`point_in_polygon` for polygons of any length, whose edges are rows (``poly_id, x1, y1, x2, y2``) of closed rings.

    Every polygon has a grid of its own. The lower right corner of a cell is inside when the edges that the lower line of its row meets further
    right are odd in number; those are counted per column and added up from the right. From there to a point of the cell, up the cell's right side and
    then left, only edges that touch the cell are met, so an edge is copied to a few cells and never to all the cells to its left. Going up, an
    edge counts by what it adds at the corner and by its ends right of that side: at every vertex two edges meet, so ends of edges that
    do not touch the side cancel out. The last step is the exact test of :func:`edge_crossed`.
    """
    grid = _edge_grid(edges)
    laid = salted_join(edges, grid.select("poly_id", "_grid"), ["poly_id"], ["x1", "y1", "x2", "y2"], EDGES_PER_TASK).withColumn("_e", F.struct("x1", "y1", "x2", "y2"))
    rows = laid.withColumn("_row", F.expr(
        f"explode(sequence({_place('least(y1, y2) - 0.01D * _grid.h', 'y')}, {_place('greatest(y1, y2) + 0.01D * _grid.h', 'y')}))"))
    corner = {"x": "_grid.min_x + (_col + 1) * _grid.w", "y": "_grid.min_y + _row * _grid.h"}

    at = rows.withColumn("_y", F.expr(corner["y"])).where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))).withColumn(
        "_x", _crossed_at(F.col("_e"), F.col("_y"))).withColumn("_at", F.expr("CAST(floor((_x - _grid.min_x) / _grid.w) AS BIGINT)"))
    # The last column whose right side lies left of the crossing, whatever rounding says.
    side = lambda c: f"_grid.min_x + ({c} + 1) * _grid.w < _x"
    last = at.selectExpr("poly_id", "_row", f"least(CASE WHEN {side('_at')} THEN _at WHEN {side('(_at - 1)')} THEN _at - 1 ELSE _at - 2 END, _grid.cols - 1) AS _col")
    met = last.where("_col >= 0").groupBy("poly_id", "_row", "_col").agg((F.count("*") % 2).alias("_n")).where("_n = 1")

    reach = lambda end: f"""CASE WHEN y1 = y2 THEN {end}(x1, x2) ELSE greatest(least({end}(
        x1 + (x2 - x1) * ((greatest(least(y1, y2), _grid.min_y + (_row - 0.01D) * _grid.h) - y1) / (y2 - y1)),
        x1 + (x2 - x1) * ((least(greatest(y1, y2), _grid.min_y + (_row + 1.01D) * _grid.h) - y1) / (y2 - y1))), greatest(x1, x2)), least(x1, x2)) END"""  # noqa: E731
    spare = "(0.01D * _grid.w + 1e-12D * (abs(x1) + abs(x2)))"
    spread = f"explode(sequence({_place(reach('least') + ' - ' + spare, 'x')}, {_place(reach('greatest') + ' + ' + spare, 'x')})) AS _col"
    cell = ["poly_id", "_row", "_col"]
    held = rows.selectExpr("poly_id", "_row", "_e", spread).groupBy(*cell).agg(F.collect_list("_e").alias("_edges"))

    pairs = point_in_box(points, grid, hot_rows).withColumns({"_row": F.expr(_place("y", "y")), "_col": F.expr(_place("x", "x"))})
    asked = pairs.select(*cell).distinct()
    marks = met.select(*cell, "_n", F.lit(False).alias("_asked")).union(asked.select(*cell, F.lit(0).cast("bigint"), F.lit(True))).withColumn(
        "_block", F.floor(F.col("_col") / BLOCK_COLS))
    block = ["poly_id", "_row", "_block"]
    later = Window.partitionBy("poly_id", "_row").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = marks.groupBy(*block).agg(F.sum("_n").alias("_in")).withColumn("_later", F.coalesce(F.sum("_in").over(later), F.lit(0))).drop("_in")
    within = marks.withColumn("_in", F.sum("_n").over(Window.partitionBy(*block).orderBy(F.desc("_col")))).where("_asked")
    corners = within.join(blocks, block).select(*cell, (F.col("_in") + F.col("_later")).alias("_met"))

    known = corners.join(held, cell, "left")
    x, y, cx, cy = F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy")
    one = lambda c: F.when(c, 1).otherwise(0)
    passed = lambda vx, vy: (vx > cx) & ((vy <= y) != (vy <= cy))
    step = lambda n, e: n + one(edge_crossed(e, x, y)) + one(_crossing(e, cx, cy)) + one(passed(e.x1, e.y1)) + one(passed(e.x2, e.y2))
    found = salted_join(pairs, known, cell, ["pt_id"], hot_rows).withColumns({"_cx": F.expr(corner["x"]), "_cy": F.expr(corner["y"])})
    crossed = F.col("_met") + F.coalesce(F.aggregate("_edges", F.lit(0), step), F.lit(0))
    return found.where(crossed % 2 == 1).drop("_grid", "_row", "_col", "_met", "_edges", "_cx", "_cy")


def radius_join(points: DataFrame, anchors: DataFrame, radius: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of points (``pt_id, x, y``) and anchors (``ax, ay``) at most ``radius`` apart.

    Cells have the edge of the radius; each anchor is copied to its cell and the eight around it.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    near = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    cell = lambda c: F.floor(c / F.lit(float(radius))).cast("bigint")
    spread = (
        anchors.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        .withColumn("_cx", cell(F.col("ax")) + F.col("_dx"))
        .withColumn("_cy", cell(F.col("ay")) + F.col("_dy"))
        .drop("_dx", "_dy")
    )
    keyed = points.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    pairs = salted_join(keyed, spread, ["_cx", "_cy"], salt_by=["pt_id"], hot_rows=hot_rows)
    apart = point_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"))
    return pairs.where(apart <= radius).drop("_cx", "_cy")

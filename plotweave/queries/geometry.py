"""Geometry, spatial joins and the zone of every point."""

from pyspark.sql import functions as F

from plotweave.fixtures import comb_vertices, faulty_polygons, frame, polygons
from plotweave.functions import geometry as geo
from plotweave.operators import geometry as op
from plotweave.operators import rings as rebuild
from plotweave.operators.zones import zone_dim
from plotweave.plans.picking import priority_pick
from plotweave.plans.spatial_join import edges_of_rings, point_in_edges, point_in_polygon
from plotweave.queries.registry import query
from plotweave.session import staging_path

_EDGES = """(SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {vertices} AS v WINDOW w AS (PARTITION BY poly_id, ring_no ORDER BY vertex_no))"""
_INSIDE = f"""
    SELECT pt_id, poly_id, zone_no FROM {{points}} AS p
    JOIN (SELECT poly_id, zone_no, x AS x1, y AS y1, x2, y2 FROM {_EDGES} AS l WHERE x2 IS NOT NULL) AS e
      ON (e.y2 > p.y) <> (e.y1 > p.y) AND p.x < (e.x1 - e.x2) * (p.y - e.y2) / (e.y1 - e.y2) + e.x2
    GROUP BY pt_id, poly_id, zone_no HAVING count(*) % 2 = 1"""


def _zoned(spark, sf):
    """Polygons with the zone value of their zone number; two of seventeen are unknown."""
    names = frame(spark, sf, "zones").select(F.col("i").cast("bigint").alias("zone_no"), "zone")
    return polygons(spark, sf).join(names, "zone_no", "left")


@query("point_in_polygon", f"SELECT pt_id, poly_id FROM ({_INSIDE}) AS i")
def _(spark, sf):
    return point_in_polygon(frame(spark, sf, "points"), polygons(spark, sf)).select("pt_id", "poly_id")


_IN_COMB = _INSIDE.replace("{vertices}", "{comb_vertices}")


@query("point_in_long_polygon", f"SELECT pt_id, poly_id FROM ({_IN_COMB}) AS i")
def _(spark, sf):
    """All points against one polygon with a vertex for every order, which is never in one row."""
    path = staging_path(spark, "comb")
    comb_vertices(spark, sf).write.parquet(f"{path}/vertices")
    edges_of_rings(spark.read.parquet(f"{path}/vertices")).write.parquet(f"{path}/edges")
    return point_in_edges(frame(spark, sf, "points"), spark.read.parquet(f"{path}/edges")).select("pt_id", "poly_id")


@query("feature_at_click", f"""
    SELECT pt_id, poly_id, z.code, z.name FROM ({_INSIDE}) AS i LEFT JOIN {{zones}} AS z ON z.i = i.zone_no""")
def _(spark, sf):
    hit = op.feature_at_click(frame(spark, sf, "points"), _zoned(spark, sf), zone_dim(spark))
    return hit.select("pt_id", "poly_id", "code", "name")


_HANDLES = ("top_left", "top_right", "bottom_right", "bottom_left")


def _frame_edge(a, b):
    """Crossing test of the edge a -> b in SQL."""
    x1, y1, x2, y2 = f"{a}_x", f"{a}_y", f"{b}_x", f"{b}_y"
    return f"(CASE WHEN ({y2} > y) <> ({y1} > y) AND x < ({x1} - {x2}) * (y - {y2}) / nullif({y1} - {y2}, 0) + {x2} THEN 1 ELSE 0 END)"


_BODY = " + ".join(_frame_edge(a, b) for a, b in zip(_HANDLES, _HANDLES[1:] + _HANDLES[:1]))
_HIT = "CASE " + " ".join(
    f"WHEN sqrt((x - {h}_x) * (x - {h}_x) + (y - {h}_y) * (y - {h}_y)) <= 12 THEN '{h}'" for h in _HANDLES
) + f" WHEN ({_BODY}) % 2 = 1 THEN 'body' END"


@query("nearest_anchor", f"""
    SELECT pt_id, frame_id, handle FROM (SELECT pt_id, frame_id, {_HIT} AS handle FROM {{points}} AS p, {{frames}} AS f
        WHERE x BETWEEN top_left_x - 20 AND top_left_x + 110 AND y BETWEEN top_left_y - 20 AND top_left_y + 90) AS h WHERE handle IS NOT NULL""")
def _(spark, sf):
    return op.nearest_anchor(frame(spark, sf, "points"), frame(spark, sf, "frames")).select("pt_id", "frame_id", "handle")


# Rectangles: the frames' upright boxes of 80 x 60.
_RECT_ANCHORS = [(0, 0), (80, 0), (80, 60), (0, 60), (0, 30), (80, 30), (40, 0), (40, 60)]
_RECT_NAMES = ("top_left", "top_right", "bottom_right", "bottom_left", "left", "right", "top", "bottom")
_RECT_HIT = "CASE " + " ".join(
    f"WHEN sqrt((x - l - {dx}) * (x - l - {dx}) + (y - t - {dy}) * (y - t - {dy})) <= 12 THEN '{name}'"
    for name, (dx, dy) in zip(_RECT_NAMES, _RECT_ANCHORS)
) + " WHEN x BETWEEN l AND l + 80 AND y BETWEEN t AND t + 60 THEN 'body' END"


@query("nearest_rect_handle", f"""
    SELECT pt_id, frame_id, handle FROM (SELECT pt_id, frame_id, {_RECT_HIT} AS handle
        FROM {{points}} AS p JOIN (SELECT frame_id, top_left_x AS l, top_left_y AS t FROM {{frames}} AS f) AS r
          ON x BETWEEN l - 20 AND l + 110 AND y BETWEEN t - 20 AND t + 90) AS h WHERE handle IS NOT NULL""")
def _(spark, sf):
    rects = frame(spark, sf, "frames").select(
        "frame_id", F.col("top_left_x").alias("left"), F.col("top_left_y").alias("top"), F.lit(80.0).alias("width"), F.lit(60.0).alias("height"))
    return op.nearest_rect_handle(frame(spark, sf, "points"), rects)


@query("priority_pick", f"""
    SELECT pt_id, min(poly_id) AS poly_id FROM ({_INSIDE}) AS i GROUP BY pt_id""")
def _(spark, sf):
    """Of several polygons over a point the first one counts."""
    hits = point_in_polygon(frame(spark, sf, "points"), polygons(spark, sf)).select("pt_id", "poly_id")
    return priority_pick(hits, ["pt_id"], ["poly_id"])


@query("in_rect", "SELECT pt_id FROM {points} AS p WHERE x >= 500 AND x <= 1500 AND y >= 700 AND y <= 2200")
def _(spark, sf):
    rect = [F.lit(v) for v in (500.0, 700.0, 1000.0, 1500.0)]
    return frame(spark, sf, "points").where(geo.in_rect(F.col("x"), F.col("y"), *rect)).select("pt_id")


@query("point_distance", "SELECT pt_id, sqrt((x - 2500) * (x - 2500) + (y - 3000) * (y - 3000)) AS distance FROM {points} AS p")
def _(spark, sf):
    d = geo.point_distance(F.col("x"), F.col("y"), F.lit(2500.0), F.lit(3000.0))
    return frame(spark, sf, "points").select("pt_id", d.alias("distance"))


# What each shape of the faulty fixture is expected to be, worked out by hand.
_REASON = """CASE shape WHEN 'open' THEN 'not closed' WHEN 'three' THEN 'too few vertices' WHEN 'bowtie' THEN 'ring touches itself'
                        WHEN 'flat' THEN 'no area' WHEN 'island' THEN 'hole outside shell' WHEN 'tangled' THEN 'ring touches itself'
                        WHEN 'leaving' THEN 'rings cross' WHEN 'overlapping' THEN 'rings cross' WHEN 'nested' THEN 'holes overlap' END"""


@query("geometry_validity", f"SELECT DISTINCT poly_id, shape, {_REASON} IS NULL AS is_valid, {_REASON} AS reason FROM {{faulty_vertices}} AS v")
def _(spark, sf):
    return op.geometry_validity(faulty_polygons(spark, sf)).select("poly_id", "shape", "is_valid", "reason")


@query("geometry_basic_repair", """
    SELECT poly_id, CASE WHEN shape IN ('bowtie', 'island', 'leaving', 'overlapping', 'nested', 'tangled') THEN FALSE WHEN shape IN ('three', 'flat') THEN FALSE ELSE TRUE END AS repaired,
           CAST(CASE WHEN shape IN ('open', 'repeated') THEN 5 ELSE n END AS INTEGER) AS n_vertices
    FROM (SELECT poly_id, shape, count(*) AS n FROM {faulty_vertices} AS v GROUP BY poly_id, shape) AS s""")
def _(spark, sf):
    tried = op.geometry_basic_repair(faulty_polygons(spark, sf))
    return tried.select("poly_id", F.col("is_valid").alias("repaired"), F.size(F.flatten("rings")).alias("n_vertices"))


# Areas by hand: what the shell goes round, less its holes; the stairs by their steps.
_AREA = """CASE shape WHEN 'ell' THEN 7500 WHEN 'holed' THEN 7500 WHEN 'three' THEN 0 WHEN 'flat' THEN 0 WHEN 'bowtie' THEN 4555.555556 WHEN 'leaving' THEN 3200
                      WHEN 'overlapping' THEN 7200 WHEN 'nested' THEN 3600 WHEN 'touching' THEN 9200 WHEN 'stairs' THEN 7625 WHEN 'tangled' THEN 7640 WHEN 'island' THEN 1600
                      ELSE 10000 END"""


@query("geometry_rebuild", f"""
    SELECT DISTINCT poly_id, shape, {_REASON} IS NULL AS was_valid, CASE WHEN shape IN ('three', 'flat') THEN 0 WHEN shape IN ('bowtie', 'tangled') THEN 2 ELSE 1 END AS n_parts,
           CAST({_AREA} AS DOUBLE) AS area FROM {{faulty_vertices}} AS v""".replace(f"{_REASON} IS NULL", f"({_REASON} IS NULL OR shape IN ('open', 'repeated'))"))
def _(spark, sf):
    made = rebuild.geometry_rebuild(faulty_polygons(spark, sf))
    return made.select("poly_id", "shape", "was_valid", F.size("parts").alias("n_parts"), F.round(rebuild.parts_area(F.col("parts")), 6).alias("area"))


@query("invalid_geometry_count", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE {_REASON} IS NOT NULL) AS invalid
    FROM (SELECT DISTINCT poly_id, shape FROM {{faulty_vertices}} AS v) AS s""")
def _(spark, sf):
    return op.invalid_geometry_count(op.geometry_validity(faulty_polygons(spark, sf)))


@query("layer_extent", """
    SELECT zone_no, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {vertices} AS v GROUP BY zone_no""")
def _(spark, sf):
    return op.layer_extent(polygons(spark, sf), ["zone_no"])

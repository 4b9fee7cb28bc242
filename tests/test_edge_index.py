"""Polygons cut into pieces, and the two grids on which points meet them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.plans import spatial_join as sj
from tests.test_plans import RINGS, crossings, star


def edges_of(rings):
    return np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1])], dtype=float)


def comb(teeth, depth=2900.0):
    low = [(k * 5000.0 / teeth, (k % 2) * depth + k * 7919 % 100) for k in range(teeth)]
    return low + [(5000.0 - k * 5000.0 / teeth, 6000.0 - (k % 2) * depth - k * 104729 % 100) for k in range(teeth)]


def shapes():
    rng = np.random.default_rng(11)
    stairs = [(float((k + 1) // 2), float(k // 2)) for k in range(60)] + [(0.0, 29.0)]
    many = [star(rng, *rng.uniform(0, 1000, 2), 20, 9) for _ in range(200)]
    return {"star": [star(rng, 3, 4, 50, 400)], "holed": [star(rng, 0, 0, 90, 300), star(rng, 0, 0, 20, 30)], "comb": [comb(300)], "stairs": [stairs],
            "many rings": many, "flat bottom": [[(float(i), 0.0) for i in range(40)] + [(39.0, 10.0), (0.0, 10.0)]]}


@pytest.mark.parametrize("name", list(shapes()))
def test_pieces_equal_the_whole(spark, name):
    """Random points, points on vertices and points level with them; also over both ends of the box."""
    rings = shapes()[name]
    vertices = np.concatenate([np.array(r) for r in rings])
    rng = np.random.default_rng(3)
    low, high = vertices.min(0), vertices.max(0)
    spread = rng.uniform(low - 0.05 * (high - low), high + 0.05 * (high - low), (300, 2))
    level = np.column_stack([rng.uniform(low[0], high[0], 150), rng.choice(vertices[:, 1], 150)])
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([spread, level, vertices[:150]]))]
    expected = {p for p, x, y in points if sum(crossings(r, x, y) for r in rings) % 2}
    found = sj.point_in_polygon(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"),
                                spark.createDataFrame([(1, rings), (1, rings)], f"poly_id BIGINT, rings {RINGS}")).collect()
    assert {r.pt_id for r in found} == expected and len(found) == 2 * len(expected)
    assert expected or name == "comb"


def gridded(spark, *rings):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"poly_id BIGINT, rings {RINGS}")
    return sj.polygon_pieces(sj._gridded(df))


def test_pieces_hold_few_edges(spark):
    """A ring of 10,000 vertices has a handful of edges to a piece, a comb some multiple of the root, but where all its teeth end at one height."""
    angle = np.linspace(0, 2 * np.pi, 10_000, endpoint=False)
    reach = 100 + 20 * np.sin(40 * angle)
    ring = list(zip((reach * np.cos(angle)).tolist(), (reach * np.sin(angle)).tolist()))
    pieces = gridded(spark, [ring], [comb(5000)]).groupBy("poly_id").agg(
        F.max(F.size("_piece.edges")).alias("most"), F.avg(F.size("_piece.edges")).alias("mean"), F.sum(F.size("_piece.edges")).alias("all")).orderBy("poly_id").collect()
    assert pieces[0].mean < 40 and pieces[0].most < 400 and pieces[0]["all"] < 60_000
    assert pieces[1].mean < 600 and pieces[1].most < 5_100


def test_short_polygons_stay_whole(spark):
    rows = gridded(spark, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]], [[(1.0, 1.0)]], [], [[(0.0, 5.0)] * 30]).collect()
    assert [(r.poly_id, len(r._piece.edges), r._piece.odd) for r in rows] == [(0, 3, False), (1, 1, False), (3, 30, False)]


@pytest.mark.parametrize("sizes", [[3] * 50, [0] * 900 + [12] * 9 + [20], [-30] * 5 + [4] * 100, [0] * 50 + [9] * 60, list(range(-5, 25)), [7]])
def test_two_grids_for_any_sizes(spark, sizes):
    """At most two levels, and in them the shapes cover few cells on average."""
    df = spark.createDataFrame([(v, 1) for v in sizes], "_level INT, _shapes INT")
    levels = spark.range(1).select(sj.two_levels(df).alias("l")).first().l
    assert 1 <= len(levels) <= 2 and levels == sorted(levels)
    used = [levels[0] if v <= levels[0] + sj.LEVELS_ABOVE else levels[-1] for v in sizes]
    assert sum(4.0 ** max(v - u, 0) for v, u in zip(sizes, used)) <= 2 * sj.CELLS_PER_SHAPE * len(sizes)
    assert levels[-1] <= max(sizes)


def test_points_without_places_or_shapes(spark):
    points = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, 1.0, 1.0), (None, 1.0, 1.0)], "pt_id BIGINT, x DOUBLE, y DOUBLE")
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    df = spark.createDataFrame([(1, square), (2, None), (None, square)], f"poly_id BIGINT, rings {RINGS}")
    assert sorted((r.pt_id or 0, r.poly_id or 0) for r in sj.point_in_polygon(points, df).collect()) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    assert sj.point_in_polygon(points, df.limit(0)).count() == 0 and sj.point_in_polygon(points.limit(0), df).count() == 0

"""Validity and repair."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.operators import geometry as op

RINGS = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"


def polygons(spark, *shapes):
    return spark.createDataFrame(list(enumerate(shapes)), f"poly_id BIGINT, rings {RINGS}")


def closed(*points):
    ring = [(float(x), float(y)) for x, y in points]
    return ring + ring[:1]


def reasons(spark, *shapes):
    return [r.reason for r in op.geometry_validity(polygons(spark, *shapes)).orderBy("poly_id").collect()]


SQUARE = closed((0, 0), (10, 0), (10, 10), (0, 10))


def test_rules(spark):
    got = reasons(
        spark,
        [SQUARE],
        [],
        None,
        [SQUARE[:3]],
        [SQUARE[:-1]],
        [closed((0, 0), (5, 0), (10, 0))],
        [closed((0, 0), (10, 10), (10, 0), (0, 8))],                  # bow-tie
        [closed((0, 0), (10, 0), (10, 10), (5, 0), (0, 10))],         # a corner touches an edge
        [closed((0, 0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10))],  # spike
        [SQUARE, closed((2, 2), (4, 2), (4, 4), (2, 4))],
        [SQUARE, closed((20, 20), (40, 20), (40, 40), (20, 40))],
        [closed((0, 0), (10, 0), (10, 0), (10, 10), (0, 10))],        # a repeated vertex is no fault
    )
    touching, none = "ring touches itself", None
    assert got == [none, "empty", "empty", "too few vertices", "not closed", "no area", touching, touching, touching, none, "hole outside shell", none]


def circle(n, wobble=0.0):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    reach = 100 + wobble * np.sin(9 * angle)
    return closed(*zip(reach * np.cos(angle), reach * np.sin(angle)))


@pytest.mark.parametrize("n", [op.PAIRWISE_EDGES - 1, op.PAIRWISE_EDGES, op.PAIRWISE_EDGES + 1, 500])
def test_long_and_short_rings(spark, n):
    good = circle(n, 20)
    crossed = good[:]
    crossed[n // 3], crossed[n // 2] = crossed[n // 2], crossed[n // 3]
    assert reasons(spark, [good], [crossed], [SQUARE, crossed]) == [None, "ring touches itself", "ring touches itself"]


def test_sweep_of_a_very_long_ring():
    x, y = np.array(circle(20_000, 20)).T
    assert op.sweep_self_contact(x[:-1], y[:-1], x[1:], y[1:]) is False
    x[5000], x[9000], y[5000], y[9000] = x[9000], x[5000], y[9000], y[5000]
    x[-1], y[-1] = x[0], y[0]
    assert op.sweep_self_contact(x[:-1], y[:-1], x[1:], y[1:]) is True


def brute_contact(points):
    """All pairs of edges, with exact integer arithmetic."""
    n = len(points)
    edges = [(points[i], points[(i + 1) % n]) for i in range(n)]

    def side(a, b, p):
        v = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        return (v > 0) - (v < 0)

    def on(a, b, p):
        return side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])

    for i in range(n):
        for j in range(i + 1, n):
            (a, b), (c, d) = edges[i], edges[j]
            if j == i + 1 or (i == 0 and j == n - 1):
                if j != i + 1:
                    (a, b), (c, d) = (c, d), (a, b)
                if side(a, b, d) == 0 and (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) < 0:
                    return True
                continue
            if on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return True
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_sweep_in_pieces(monkeypatch, at_once):
    monkeypatch.setattr(op, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    seen = set()
    for _ in range(200):
        points = [tuple(int(v) for v in rng.integers(0, 12, 2)) for _ in range(rng.integers(4, 7))]
        points = [p for i, p in enumerate(points) if p != points[i - 1]]
        if len(points) < 4:
            continue
        a = np.array(points, dtype=float)
        b = np.roll(a, -1, axis=0)
        expected = brute_contact(points)
        seen.add(expected)
        assert op.sweep_self_contact(a[:, 0], a[:, 1], b[:, 0], b[:, 1]) == expected
    assert seen == {True, False}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=4, max_size=9))
def test_sweep_equals_all_pairs(points):
    points = [p for i, p in enumerate(points) if p != points[i - 1]]
    if len(points) < 4:
        return
    a = np.array(points, dtype=float)
    b = np.roll(a, -1, axis=0)
    assert op.sweep_self_contact(a[:, 0], a[:, 1], b[:, 0], b[:, 1]) == brute_contact(points)


def test_pairwise_in_spark_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    shapes = []
    while len(shapes) < 200:
        points = [tuple(int(v) for v in rng.integers(0, 7, 2)) for _ in range(rng.integers(4, 8))]
        points = [p for i, p in enumerate(points) if p != points[i - 1]]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))
        if len(points) >= 3 and area:
            shapes.append(points)
    got = reasons(spark, *[[closed(*p)] for p in shapes])
    assert [r is not None for r in got] == [brute_contact(p) for p in shapes]
    assert len(set(got)) == 2


def test_repair(spark):
    bow = closed((0, 0), (10, 10), (10, 0), (0, 8))
    tried = op.geometry_basic_repair(polygons(
        spark,
        [SQUARE[:-1]],                                       # closed by repair
        [closed((0, 0), (10, 0), (10, 0), (10, 10), (0, 10))],   # repeated vertex goes
        [SQUARE, [], closed((1, 1), (2, 2), (1, 1))],        # empty and flat rings go
        [bow],
        [closed((0, 0), (1, 1), (2, 2))],
    ))
    got = {r.poly_id: [[tuple(v) for v in ring] for ring in r.rings] for r in tried.where("is_valid").collect()}
    assert got == {0: [SQUARE], 1: [SQUARE], 2: [SQUARE]}
    left = {r.poly_id: r for r in tried.where("NOT is_valid").collect()}
    assert left[3].reason == "ring touches itself" and [tuple(v) for v in left[3].rings[0]] == bow
    assert left[4].reason == "empty"


def test_filter_on_validity_runs_the_sweep_once(spark):
    valid = op.geometry_validity(polygons(spark, [circle(200)])).where("is_valid")
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rings_against_each_other(spark):
    """Holes that cross the shell, touch it, overlap, lie in each other or along an edge; short and long rings."""
    big = closed((0, 0), (100, 0), (100, 100), (0, 100))
    box = lambda x, y, d: closed((x, y), (x + d, y), (x + d, y + d), (x, y + d))
    diamond = closed((0, 50), (20, 30), (40, 50), (20, 70))
    ring = [(50 + 30 * math.cos(i * math.pi / 20), 50 + 30 * math.sin(i * math.pi / 20)) for i in range(40)]
    wide = [(50 + 60 * math.cos(i * math.pi / 20), 50 + 60 * math.sin(i * math.pi / 20)) for i in range(40)]
    got = reasons(
        spark, [big, box(10, 10, 20), box(50, 50, 20)], [big, box(90, 40, 20)], [big, diamond], [big, box(10, 10, 30), box(20, 20, 30)],
        [big, box(10, 10, 60), box(20, 20, 10)], [big, box(0, 40, 20)], [big, box(200, 0, 10)], [big, closed(*ring)], [big, closed(*wide)],
        [big, box(10, 10, 20), box(30, 30, 20)], [big, box(10, 10, 20), box(10, 10, 20)])
    assert got == [None, "rings cross", None, "rings cross", "holes overlap", "rings cross", "hole outside shell", None, "rings cross", None, "rings cross"]


# --- rings against each other ----------------------------------------------------------------------


def brute_conflict(rings):
    """All pairs of rings, hole by hole."""
    def conflict(a, b):
        first, second = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        return op._edges_conflict(a[first], b[second]).any()

    def place(edges, points):
        found = []
        for x, y in points:
            x1, y1, x2, y2 = edges.T
            side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            on = (side == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
            crossed = ((y1 > y) != (y2 > y)) & (np.sign(side) == np.where(y2 > y1, 1, -1))
            found.append(0 if on.any() else 1 if crossed.sum() % 2 else -1)
        return np.array(found)

    for j, hole in enumerate(rings[1:], 1):
        if any(conflict(rings[i], hole) for i in range(j)):
            return "rings cross"
        if (place(rings[0], hole[:, :2]) < 0).any():
            return "hole outside shell"
        for i in range(1, j):
            if (place(rings[i], hole[:, :2]) > 0).any() or (place(hole, rings[i][:, :2]) > 0).any():
                return "holes overlap"
    return None


def edge_array(points):
    a = np.array(points, dtype=float)
    return np.concatenate([a, np.roll(a, -1, axis=0)], axis=1)


def test_conflicts_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    seen = set()
    for k in range(1500):
        monkeypatch.setattr(op, "PAIRS_AT_ONCE", int(rng.choice([3, 50, 1_000_000])))
        shapes = [edge_array([(0, 0), (20, 0), (20, 20), (0, 20)])]
        for _ in range(rng.integers(1, 6)):
            x, y = rng.integers(-1, 18, 2)
            w, h = rng.integers(1, 5 if k % 3 else 12, 2)
            box = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            shapes.append(edge_array(box if k % 2 else [(x, y), (x + w, y + 1), (x + w // 2, y + h)]))
        want = brute_conflict(shapes)
        seen.add(want)
        assert op.rings_conflict(shapes) == want
    assert seen == {None, "rings cross", "hole outside shell", "holes overlap"}


def test_many_holes(spark):
    """20,000 holes and a shell of 10,000 vertices; also with the last hole over another one, or outside."""
    shell = circle(10_000, 10)
    spots = [(-60 + 0.8 * (i % 150), -55 + 0.8 * (i // 150)) for i in range(20_000)]
    small = lambda x, y: closed((x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5))
    rings = [edge_array(shell[:-1]), *[edge_array(small(x, y)[:-1]) for x, y in spots]]
    assert op.rings_conflict(rings) is None
    assert op.rings_conflict([*rings, edge_array([(-59.9, -54.9), (-59.8, -54.9), (-59.8, -54.8)])]) == "holes overlap"
    assert op.rings_conflict([*rings, edge_array([(300, 0), (301, 0), (301, 1)])]) == "hole outside shell"
    assert reasons(spark, [shell, *[small(x, y) for x, y in spots[:3000]]]) == [None]

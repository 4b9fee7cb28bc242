"""Nesting of rings and polygons rebuilt from crossing rings."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.operators import geometry, rings
from tests.test_geometry import closed, polygons


def square(x, y, size):
    return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)], dtype=float)


def winding(ring, x, y):
    count = 0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            count += 1 if y2 > y1 else -1
    return count


def wanted(given_rings, x, y):
    return winding(given_rings[0], x, y) != 0 and all(winding(r, x, y) == 0 for r in given_rings[1:])


def covered(parts, x, y):
    return sum(winding(p[0][:-1], x, y) != 0 and all(winding(h[:-1], x, y) == 0 for h in p[1:]) for p in parts)


def assert_valid(parts):
    for part in parts:
        edges = [rings._edges(np.array(r[:-1])) for r in part]
        for r, e in zip(part, edges):
            assert r[0] == r[-1] and len(r) >= 4
            assert not geometry.sweep_self_contact(*e.T), part
        assert rings._area(np.array(part[0][:-1])) > 0 and all(rings._area(np.array(h[:-1])) < 0 for h in part[1:])
        assert geometry.rings_conflict(edges) is None, part


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=3, max_size=9), min_size=1, max_size=3))
def test_rebuilt_covers_what_the_shell_winds_round(given_rings):
    """On whole numbers crossings and overlaps of every kind are frequent."""
    parts = rings.rebuilt([np.array(r, dtype=float) for r in given_rings])
    for x in np.arange(0.31, 8, 0.87):
        for y in np.arange(0.17, 8, 0.79):
            assert covered(parts, x, y) == wanted(given_rings, x, y)
    for part in parts:
        assert all(r[0] == r[-1] and len(r) >= 4 and len(set(r)) == len(r) - 1 for r in part)


def test_parts_are_valid():
    cross = [(0, 0), (10, 10), (10, 0), (0, 8)]
    star = [(0, 3), (10, 3), (2, 10), (5, 0), (8, 10)]
    twice = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (10, 0), (10, 10), (0, 10)]
    spike = [(0, 0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10)]
    hole_on_corner = [square(0, 0, 10), np.array([(0, 0), (4, 2), (2, 4)])]
    chain = [square(0, 0, 10), np.array([(0, 5), (5, 3), (10, 5), (5, 7)])]  # a hole that cuts the shell in two
    known = [([star], 1, None), ([twice], 1, 100.0), ([spike], 1, 100.0), (hole_on_corner, 1, 94.0), (chain, 2, 80.0), ([cross], 2, None),
             ([square(0, 0, 10), square(0, 0, 10)], 0, 0.0), ([square(0, 0, 10), square(-5, -5, 30)], 0, 0.0)]
    for shape, n, area in known:
        parts = rings.rebuilt([np.array(r, dtype=float) for r in shape])
        assert_valid(parts)
        total = sum(abs(rings._area(np.array(p[0]))) - sum(abs(rings._area(np.array(h))) for h in p[1:]) for p in parts)
        assert len(parts) == n and (area is None or abs(total - area) < 1e-9), shape


def test_long_tangled_ring():
    """20,000 vertices that cross in many places."""
    angle = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    reach = 100 + 5 * np.sin(900.5 * angle)
    ring = np.column_stack([reach * np.cos(angle), reach * np.sin(2 * angle)])
    began = time.time()
    parts = rings.rebuilt([ring])
    assert time.time() - began < 60
    assert_valid(parts)
    rng = np.random.default_rng(1)
    flat = ring.tolist()
    assert all(covered(parts, x, y) == wanted([flat], x, y) for x, y in rng.uniform(-105, 105, (25, 2)))


def test_groups_by_depth():
    deep = [square(i, i, 100 - 2 * i) for i in range(7)]
    order = [3, 0, 6, 2, 5, 1, 4]
    groups = rings.ring_groups([deep[i] for i in order])
    assert sorted([order[i] for i in g] for g in groups) == [[0, 1], [2, 3], [4, 5], [6]]
    corner = [square(0, 0, 10), np.array([(0, 0), (4, 2), (2, 4), (0, 0)], dtype=float)]  # touches the shell where it starts
    assert rings.ring_groups(corner) == [[0, 1]] and rings.ring_groups(corner[::-1]) == [[1, 0]]
    assert rings.ring_groups([square(0, 0, 4), square(0, 0, 4)]) == [[0], [1]]
    assert rings.ring_groups([]) == [] and rings.ring_groups([np.empty((0, 2)), square(0, 0, 1)]) == [[1]]


def test_many_holes_and_islands():
    holes = [square(10 * i, 10 * j, 6) for i in range(50) for j in range(50)]
    islands = [square(10 * i + 2, 10 * j + 2, 2) for i in range(50) for j in range(50)]
    began = time.time()
    groups = rings.ring_groups([*islands, *holes, square(-10, -10, 600)])
    assert time.time() - began < 30
    assert groups == [*[[i] for i in range(2500)], [5000, *range(2500, 5000)]]


def test_rebuild_of_odd_polygons(spark):
    ring = closed((0, 0), (10, 10), (10, 0), (0, 10))
    rows = rings.geometry_rebuild(polygons(spark, None, [], [[]], [ring], [[(1.0, 1.0)]], [closed((0, 0), (4, 0), (4, 4))], [[], closed((0, 0), (4, 0), (4, 4))])).orderBy("poly_id").collect()
    assert [(r.was_valid, len(r.parts)) for r in rows] == [(False, 0), (False, 0), (False, 0), (False, 2), (False, 0), (True, 1), (False, 0)]
    assert rows[3].rings == [[tuple(v) for v in ring]] and rings.geometry_rebuild(polygons(spark, None).limit(0)).count() == 0

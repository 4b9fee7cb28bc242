"""Building blocks against their plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plotweave.fixtures import comb_vertices
from plotweave.operators.geometry import nearest_anchor, nearest_rect_handle
from plotweave.plans.once import with_once
from plotweave.plans.ordered import ordered_lag, ordered_row_number, ordered_slice
from plotweave.plans.picking import priority_pick
from plotweave.plans.skew import block_join, marked, missing_from, salted_join
from plotweave.plans.spatial_join import edges_of_rings, point_in_edges, point_in_polygon, radius_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, and some without key."""
    return spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 1000).alias("o"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("v"),
    )


def segment(width=100):
    """Ranges of the order column."""
    return F.floor(F.col("o") / width)


def test_row_number_equals_window(skewed):
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    ours = ordered_row_number(skewed, ["o", "id"], segment(), ["k"], "n")
    assert rows(ours, "id", "n") == rows(plain, "id", "n")


def test_row_number_without_key_and_with_null_segments(skewed):
    some = skewed.withColumn("o", F.when(F.col("o") > 50, F.col("o")))
    ours = ordered_row_number(some, ["o", "id"], segment(), name="n")
    assert [r["n"] for r in ours.orderBy("o", "id").collect()] == list(range(1, 6001))


def test_row_number_spreads_a_hot_key(skewed):
    """One key alone still uses many tasks, and nothing is checkpointed."""
    one = skewed.withColumn("k", F.lit(1))
    ours = ordered_row_number(one, ["o", "id"], segment(), ["k"], "n")
    assert sorted(r["n"] for r in ours.collect()) == list(range(1, 6001))
    assert "checkpoint" not in plan(ours).lower()
    shares = one.groupBy("k", segment()).count().collect()
    assert len(shares) == 10 and max(r["count"] for r in shares) < 1000


def test_slice_sorts_only_its_segments(skewed):
    got = ordered_slice(skewed, ["o", "id"], segment(), 1250, 300)
    want = skewed.orderBy("o", "id").limit(1550).collect()[1250:]
    assert rows(got, "o", "id") == sorted(((r["o"], r["id"]) for r in want), key=repr)
    assert ordered_slice(skewed, ["o", "id"], segment(), 5990, 100).count() == 10
    assert ordered_slice(skewed, ["o", "id"], segment(), 9000, 100).count() == 0


def test_lag_equals_window(skewed):
    plain = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o", "id")))
    ours = ordered_lag(skewed, "v", ["k"], ["o", "id"], segment(), "p")
    assert rows(ours, "id", "p") == rows(plain, "id", "p")


def test_priority_pick_limits_before_the_shuffle(skewed):
    picked = priority_pick(skewed, ["k"], ["o", "id"], 2)
    text = plan(picked)
    assert text.count("WindowGroupLimit") == 2, text
    assert picked.groupBy("k").count().where("count > 2").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(
        spark.createDataFrame([(0, 777)], "k BIGINT, w BIGINT"))
    plain = skewed.join(right, ["k"], how)
    ours = salted_join(skewed, right, ["k"], salt_by=["id"], hot_rows=300, how=how)
    assert rows(ours, "id", "k", "w") == rows(plain, "id", "k", "w")


def test_salted_join_takes_counts(spark, skewed):
    counts = skewed.groupBy("k").agg(F.count("*").alias("_rows"))
    right = counts.where("k % 2 = 0").select("k", (F.col("k") * 10).alias("x"))
    ours = salted_join(skewed, right, ["k"], salt_by=["id"], hot_rows=300, counts=counts)
    assert rows(ours, "k", "id", "x") == rows(skewed.join(right, "k"), "k", "id", "x")
    known = spark.createDataFrame(counts.collect(), counts.schema)
    assert "count(" not in plan(salted_join(skewed, known.drop("_rows"), ["k"], ["id"], 300, counts=known))


def test_block_join_equals_join(spark, skewed):
    left = skewed.withColumn("h", F.xxhash64("id"))
    right = spark.range(900).select(
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 9 == 1, F.lit(None)).otherwise(F.col("id") % 60).alias("k"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 200).cast("string")).alias("w"))
    plain = left.where("id < 900").join(right, "k").groupBy("k", "id", "h", "o", "v", "w").count()
    ours = block_join(left.where("id < 900"), right, "k", "h", "w", rows=20, values=30)
    assert ours.columns == ["k", "id", "o", "v", "h", "w"]
    assert rows(ours.groupBy("k", "id", "h", "o", "v", "w").count(), "k", "id", "w", "count") == rows(plain, "k", "id", "w", "count")


def test_a_key_on_both_sides_is_split_into_blocks(spark):
    """A result of 160,000 rows from 400 and 400 of one key is not one task's work."""
    k = F.when(F.col("id") >= 0, "a").otherwise("b").alias("k")
    pairs = block_join(spark.range(400).select(k, F.xxhash64("id").alias("h")), spark.range(400).select(k, "id"), "k", "h", "id", rows=40, values=100)
    counts = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 160_000 and max(counts) < 60_000


def test_marked_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    every = spark.range(100_000).select("id", F.when(F.col("id") % 10 != 1, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    kept = marked(every, keys, "k")
    assert kept.columns == ["id", "k"] and kept.count() < 1200
    assert rows(kept.join(keys, "k", "left_semi"), "id") == rows(every.join(keys, "k", "left_semi"), "id")
    assert marked(every, keys.limit(0), "k").count() == 0


def test_rows_without_key_are_spread(spark):
    """Half of the rows have no key; a left join must not send them all to one task."""
    left = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, ["k"], salt_by=["id"], hot_rows=100, how="left")
        shares = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(shares) == 8000 and max(shares) < 2000


def test_keys_are_counted_whatever_the_size(spark, sf):
    """One plan for inputs of every size: an exploded left side looks small to the planner and is not."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    customers = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    assert "Aggregate" in plan(salted_join(orders, customers, ["o_custkey"], ["o_orderkey"]))


def test_hot_key_is_split(spark):
    """A key with a third of the rows ends up in several tasks."""
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(6000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, ["k"], salt_by=["id"], hot_rows=100)
        tasks = joined.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in tasks) == 2000 and len(tasks) > 4 and max(r["count"] for r in tasks) < 1000


def test_expression_is_evaluated_once(spark):
    texts = spark.range(3).select(F.concat(F.lit('{"a": '), "id", F.lit("}")).alias("t"))
    parsed = with_once(texts, "p", F.from_json("t", "a INT, b INT")).where("p.a > 0 AND p.b IS NULL").select("p.a")
    assert plan(parsed).count("from_json") == 1 and sorted(r.a for r in parsed.collect()) == [1, 2]


def test_salted_join_rejects_right_joins(skewed):
    with pytest.raises(ValueError):
        salted_join(skewed, skewed, ["k"], ["id"], how="full")


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_missing_from_splits_hot_keys(spark, hot_rows):
    """A hot key with and without a match, keys of no rows on the other side, null keys, repeated rows, and a map that cannot be hashed."""
    rows = [("hot", i) for i in range(50)] + [("gone", i) for i in range(50)] + [("one", 1), ("one", 1), (None, 7), (None, 7), (None, 8)]
    left = spark.createDataFrame(rows, "k STRING, n INT").withColumn("m", F.create_map(F.lit("a"), F.col("n")))
    right = spark.createDataFrame([("hot",), ("hot",), (None,), ("other",)], "k STRING")
    got = missing_from(left, right, "k", hot_rows)
    assert got.columns == ["k", "n", "m"]
    assert sorted((str(r.k), r.n) for r in got.collect()) == sorted((str(k), n) for k, n in rows if k != "hot")
    assert missing_from(left, right.limit(0), "k", hot_rows).count() == len(rows)


# --- spatial ---------------------------------------------------------------------------------------

RINGS = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"


def crossings(ring, x, y):
    count = 0
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1]] + ring[:-1]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            count += 1
    return count


def star(rng, cx, cy, radius, corners):
    angles = np.sort(rng.uniform(0, 2 * np.pi, corners))
    reach = rng.uniform(0.3, 1, corners) * radius
    return [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(angles, reach)]


@pytest.fixture(scope="module")
def scene(spark):
    """Stars of very different sizes, some with holes, and points around, a third of them in one spot."""
    rng = np.random.default_rng(7)
    shapes = []
    for i in range(120):
        cx, cy = rng.uniform(-100, 100, 2)
        radius = 10 ** rng.uniform(-1, 2)
        rings = [star(rng, cx, cy, radius, 9)]
        if i % 4 == 0:
            rings.append(star(rng, cx, cy, radius / 4, 6))
        shapes.append((i, rings))
    points = [(i, *(float(v) for v in rng.uniform(-120, 120, 2))) for i in range(600)]
    points += [(1000 + i, 3.25 + i * 1e-6, 4.5) for i in range(300)]
    return (
        spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"),
        spark.createDataFrame(shapes, f"poly_id BIGINT, rings {RINGS}"), points, shapes,
    )


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_point_in_polygon_equals_nested_loop(scene, hot_rows):
    points_df, shapes_df, points, shapes = scene
    expected = sorted((p, s) for p, x, y in points for s, rings in shapes if sum(crossings(r, x, y) for r in rings) % 2)
    assert len(expected) > 500
    found = point_in_polygon(points_df, shapes_df, hot_rows)
    assert sorted((r.pt_id, r.poly_id) for r in found.collect()) == expected


def test_point_in_polygon_on_edges(spark):
    """Squares that share edges: every point of the area lies in exactly one."""
    squares = [(i * 4 + j, [[(i * 8.0, j * 8.0), (i * 8.0 + 8, j * 8.0), (i * 8.0 + 8, j * 8.0 + 8), (i * 8.0, j * 8.0 + 8)]])
               for i in range(4) for j in range(4)]
    points = [(a * 32 + b, float(a), float(b)) for a in range(32) for b in range(32)]
    found = point_in_polygon(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"),
                             spark.createDataFrame(squares, f"poly_id BIGINT, rings {RINGS}"))
    assert {r.pt_id: r.poly_id for r in found.collect()} == {p: int(x // 8) * 4 + int(y // 8) for p, x, y in points}
    assert found.count() == len(points)


def test_point_in_polygon_without_polygons(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "pt_id BIGINT, x DOUBLE, y DOUBLE")
    empty = spark.createDataFrame([(1, [])], f"poly_id BIGINT, rings {RINGS}")
    assert point_in_polygon(points, empty).count() == 0


def test_point_in_polygon_joins_on_cells(scene):
    text = plan(point_in_polygon(scene[0], scene[1]))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_radius_join_equals_nested_loop(spark, hot_rows):
    rng = random.Random(3)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)] + [(900 + i, 1.0, 2.0) for i in range(50)]
    anchors = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(80)] + [(99, 5.0, 5.0)]
    found = radius_join(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"),
                        spark.createDataFrame(anchors, "a INT, ax DOUBLE, ay DOUBLE"), 5.0, hot_rows)
    expected = sorted((p, a) for p, x, y in points for a, ax, ay in anchors if ((x - ax) * (x - ax) + (y - ay) * (y - ay)) ** 0.5 <= 5.0)
    assert (900, 99) in expected  # exactly on the circle
    assert sorted((r.pt_id, r.a) for r in found.collect()) == expected


def test_nearest_anchor_prefers_order_over_distance(spark):
    corners = dict(top_left=(0.0, 0.0), top_right=(15.0, 0.0), bottom_right=(100.0, 80.0), bottom_left=(0.0, 80.0))
    names = ["frame_id"] + [f"{c}_{a}" for c in corners for a in "xy"]
    frame = spark.createDataFrame([(1, *(v for xy in corners.values() for v in xy))], names)
    points = [(1, 11.0, 0.0), (2, 27.0, 0.0), (3, 40.0, 60.0), (4, 500.0, 500.0), (5, 0.0, 12.0), (6, 0.0, 12.001)]
    found = nearest_anchor(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"), frame)
    assert {r.pt_id: r.handle for r in found.collect()} == {1: "top_left", 2: "top_right", 3: "body", 5: "top_left", 6: "body"}


def test_rect_handles(spark):
    rect = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 60.0)], "frame_id INT, left DOUBLE, top DOUBLE, width DOUBLE, height DOUBLE")
    points = [(1, 0.0, 12.0), (2, 0.0, 13.0), (3, -12.0, 30.0), (4, 50.0, 65.0), (5, 100.0, 45.0), (6, 100.0, 44.0), (7, 30.0, 60.0), (8, 30.0, 60.1), (9, 50.0, 30.0)]
    found = nearest_rect_handle(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"), rect)
    assert {r.pt_id: r.handle for r in found.collect()} == {
        1: "top_left", 2: "body", 3: "left", 4: "bottom", 5: "body", 6: "body", 7: "body", 9: "body"}


def test_rect_handles_are_not_broadcast(spark):
    """72 copies of every rectangle look as small as the rectangles; only the counts of hot cells go to all tasks."""
    points = spark.range(100).selectExpr("id AS pt_id", "CAST(id * 7 AS DOUBLE) AS x", "CAST(id * 5 AS DOUBLE) AS y")
    rects = spark.range(50).selectExpr("id AS frame_id", "CAST(id * 20 AS DOUBLE) AS left", "CAST(id * 15 AS DOUBLE) AS top", "18D AS width", "12D AS height")
    text = plan(nearest_rect_handle(points, rects))
    assert text.count("SortMergeJoin") == 2 and "Inner, BuildRight" not in text and "Inner, BuildLeft" not in text


def test_frame_corners_are_not_broadcast(spark):
    """Neither the nine copies of each corner nor the cells of a frame are."""
    points = spark.range(100).selectExpr("id AS pt_id", "CAST(id * 7 AS DOUBLE) AS x", "CAST(id * 5 AS DOUBLE) AS y")
    at = {"top_left": (0, 0), "top_right": (18, 1), "bottom_right": (17, 13), "bottom_left": (1, 12)}
    frames = spark.range(50).selectExpr("id AS frame_id", *[
        f"CAST(id * {step} + {d} AS DOUBLE) AS {name}_{axis}" for name, (dx, dy) in at.items() for axis, step, d in (("x", 20, dx), ("y", 15, dy))])
    text = plan(nearest_anchor(points, frames))
    assert text.count("SortMergeJoin") == 2 and "Inner, BuildRight" not in text and "Inner, BuildLeft" not in text


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_points_in_edges_equal_nested_loop(spark, scene, hot_rows):
    """Stars, combs with level teeth, and rings that cross themselves, with points on vertices, on edges and level with them."""
    points_df, _, points, shapes = scene
    rng = random.Random(4)
    comb = [(k / 2, float(k % 2 * (20 + k % 7))) for k in range(200)] + [(k / 2, 50.0 - k % 2 * (20 + k % 5)) for k in range(199, -1, -1)]
    tangle = [(float(rng.randrange(-40, 40)), float(rng.randrange(-40, 40))) for _ in range(150)]
    steps = [(float(k // 2), float((k + 1) // 2)) for k in range(80)] + [(60.0, 0.0)]
    shapes = shapes[:30] + [(900, [comb]), (901, [tangle]), (902, [steps, tangle[:40]])]
    points = points[:200] + points[600:650] + [(5000 + i, x, y) for i, (x, y) in enumerate(comb[:60] + tangle[:60] + steps[:40])]
    points += [(9000 + i, float(rng.randrange(-50, 110)) / 2, float(rng.randrange(-50, 110)) / 2) for i in range(300)]
    vertices = [(s, r, k, x, y) for s, rings in shapes for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    edges = edges_of_rings(spark.createDataFrame(vertices, "poly_id BIGINT, ring_no INT, vertex_no INT, x DOUBLE, y DOUBLE"))

    def inside(rings, x, y):  # edges in the direction of the ring, as the operator has them
        return sum((y1 > y) != (y2 > y) and x < (x1 - x2) * (y - y2) / (y1 - y2) + x2
                   for ring in rings for (x1, y1), (x2, y2) in zip([ring[-1]] + ring[:-1], ring)) % 2

    expected = sorted((p, s) for p, x, y in points for s, rings in shapes if inside(rings, x, y))
    assert len(expected) > 300
    found = point_in_edges(spark.createDataFrame(points, "pt_id BIGINT, x DOUBLE, y DOUBLE"), edges, hot_rows)
    assert sorted((r.pt_id, r.poly_id) for r in found.collect()) == expected


def test_edges_of_a_comb_are_copied_to_few_cells(spark):
    """All teeth of this comb end at four heights, so cells to the left of an edge that ends in their row must not get it."""
    n = 20_000
    ring = spark.range(n).selectExpr("1L AS poly_id", "0 AS ring_no", "id AS vertex_no", f"IF(id < {n // 2}, id, {n - 1} - id) * 1D AS x",
                                     f"IF(id < {n // 2}, id % 2 * 2900D, 6000D - id % 2 * 2900D) AS y")
    points = spark.range(500).selectExpr("id AS pt_id", f"CAST(id * 7919 % {n // 2} AS DOUBLE) + 0.25D AS x", "CAST(id * 104729 % 6000 AS DOUBLE) AS y")
    found = point_in_edges(points, edges_of_rings(ring).cache()).count()
    assert 100 < found < 400


def test_comb_of_many_orders(spark, tmp_path):
    """Beyond 271,000 orders the products of the fixture need more than 32 bits."""
    spark.range(300_000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = comb_vertices(spark, str(tmp_path)).where("vertex_no IN (0, 149999, 280000, 299999, 300000)").orderBy("vertex_no").collect()
    y = [0, 2900 + 149999 * 7919 % 100, 6000 - 280000 * 104729 % 100, 6000 - 2900 - 299999 * 104729 % 100, 0]
    assert [(r.x, r.y) for r in found] == list(zip([0.0, 149999 * 5000 / 150000, 19999 * 5000 / 150000, 0.0, 0.0], y))

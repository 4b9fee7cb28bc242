"""Label table: merge rules, progress, corrections, checks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plotweave.fixtures import frame, geolabels, label_events
from plotweave.operators import catalog as cat
from plotweave.operators import files as fl
from plotweave.operators import labels as op
from plotweave.schemas import CORNER_COLUMNS, CORNERS

SQUARE = {"top_left": (0.0, 10.0), "top_right": (10.0, 10.0), "bottom_right": (10.0, 0.0), "bottom_left": (0.0, 0.0)}
COLUMNS = ["pdf_hash", "pdf_path", *CORNER_COLUMNS]


def label(pdf_hash, path="p", shift=0.0):
    return (pdf_hash, path, *(v + shift for c in CORNERS for v in SQUARE[c]))


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


@pytest.fixture
def stored(spark):
    rows = [(*label("a"), at(1), at(2)), (*label("b"), at(1), at(3))]
    schema = ", ".join(f"{c} {'STRING' if c.startswith('pdf') else 'DOUBLE'}" for c in COLUMNS)
    return spark.createDataFrame(rows, schema + ", created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ")


@pytest.fixture
def changes(spark):
    rows = [(*label("a", "new", 1.0), at(9)), (*label("c", "c", 2.0), at(8))]
    schema = ", ".join(f"{c} {'STRING' if c.startswith('pdf') else 'DOUBLE'}" for c in COLUMNS)
    return spark.createDataFrame(rows, schema + ", ts TIMESTAMP_NTZ")


def by_hash(df):
    return {r.pdf_hash: r for r in df.collect()}


def test_upsert_keeps_creation_time(stored, changes):
    got = by_hash(op.label_upsert(stored, changes))
    assert (got["a"].pdf_path, got["a"].created_at, got["a"].updated_at, got["a"].top_left_lng) == ("new", at(1), at(9), 1.0)
    assert (got["b"].pdf_path, got["b"].created_at, got["b"].updated_at) == ("p", at(1), at(3))
    assert (got["c"].created_at, got["c"].updated_at) == (at(8), at(8))


def test_upsert_is_idempotent(stored, changes):
    once = op.label_upsert(stored, changes)
    assert by_hash(op.label_upsert(once, changes)) == by_hash(once)


def test_upsert_at_a_given_time(stored, changes):
    got = by_hash(op.label_upsert(stored, changes, now="2024-02-01 00:00:00"))
    assert got["a"].updated_at == got["c"].created_at == dt.datetime(2024, 2, 1)


def test_upsert_then_delete(spark, stored, changes):
    merged = op.label_upsert(stored, changes)
    assert set(by_hash(op.label_delete(merged, spark.createDataFrame([("a",), ("zz",)], "pdf_hash STRING")))) == {"b", "c"}


def test_flatten_reverses_nest(spark, sf):
    labels = geolabels(spark, sf)
    back = op.labels_flat(op.labels_nested(labels))
    assert by_hash(back) == by_hash(labels.select(*COLUMNS))


def test_progress_counts_orphans_apart(spark, sf):
    documents = cat.catalog(frame(spark, sf, "manifest"))
    got = op.label_progress(documents, geolabels(spark, sf)).first()
    assert got.labeled_total == geolabels(spark, sf).count() and got.total == documents.count()
    assert op.label_status(documents, geolabels(spark, sf)).where("is_labeled").count() == got.labeled_in_catalog
    assert op.unlabeled_documents(documents, geolabels(spark, sf)).count() == got.total - got.labeled_in_catalog


def test_lookup_maps_stay_small(spark, sf):
    labels = geolabels(spark, sf)
    maps = op.labels_as_map(labels, digits=2)
    sizes = [r[0] for r in maps.select(F.size("labels")).collect()]
    assert sum(sizes) == labels.count() and max(sizes) < 30


def corners(row):
    return {c: (row[f"{c}_lng"], row[f"{c}_lat"]) for c in CORNERS}


def test_scale_about_the_opposite_corner(spark, stored):
    scales = spark.createDataFrame([("a", "top_right", 20.0, 20.0)], "pdf_hash STRING, handle STRING, to_lng DOUBLE, to_lat DOUBLE")
    got = by_hash(op.scale_corners(stored, scales))
    assert corners(got["a"]) == {"top_left": (0, 20), "top_right": (20, 20), "bottom_right": (20, 0), "bottom_left": (0, 0)}
    assert corners(got["b"]) == SQUARE


def test_scale_of_a_point_leaves_it(spark, stored):
    flat = stored.withColumns({c: F.lit(1.0) for c in CORNER_COLUMNS})
    scales = spark.createDataFrame([("a", "top_left", 5.0, 5.0)], "pdf_hash STRING, handle STRING, to_lng DOUBLE, to_lat DOUBLE")
    assert set(corners(by_hash(op.scale_corners(flat, scales))["a"]).values()) == {(1.0, 1.0)}


def test_quarter_turn(spark, stored):
    turned = by_hash(op.rotate_corners(stored, spark.createDataFrame([("a", math.pi / 2)], "pdf_hash STRING, angle DOUBLE")))
    assert corners(turned["a"])["top_right"] == pytest.approx((0, 10))
    assert corners(turned["a"])["top_left"] == pytest.approx((0, 0))


def test_translate(spark, stored):
    moved = by_hash(op.translate_corners(stored, spark.createDataFrame([("a", 1.0, -1.0)], "pdf_hash STRING, dx DOUBLE, dy DOUBLE")))
    assert corners(moved["a"])["top_left"] == (1.0, 9.0) and corners(moved["b"]) == SQUARE


def test_pixel_corners_map_to_label_corners(spark, stored):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 200.0, 0.0), ("a", 200.0, 100.0), ("a", 100.0, 50.0), ("zz", 0.0, 0.0)],
                                   "pdf_hash STRING, px DOUBLE, py DOUBLE")
    got = {(r.px, r.py): (r.lng, r.lat) for r in op.pixel_to_geo(points, stored, 200, 100).collect()}
    assert got == {(0, 0): (0, 10), (200, 0): (10, 10), (200, 100): (10, 0), (100, 50): (5, 5)}


def test_extent_of_all(stored):
    assert op.corners_bbox(stored, by=[]).first().asDict() == {"west": 0.0, "south": 0.0, "east": 10.0, "north": 10.0}


def test_unique_hash_check(stored):
    twice = stored.unionByName(stored.where("pdf_hash = 'a'")).unionByName(
        stored.where("pdf_hash = 'b'").withColumns({"pdf_hash": F.lit(None).cast("string"), "top_left_lng": F.lit(None).cast("double")}))
    got = {r.rule: (r.passed, r.violations) for r in fl.unique_hash_check(twice).collect()}
    assert got == {"hash_present": (False, 1), "hash_unique": (False, 1), "corners_present": (False, 1)}


# --- files and ledgers -----------------------------------------------------------------------------


def test_collection_validate(spark):
    results = spark.createDataFrame([("ok", True, ["f1"]), ("small", True, ["f1", "f2"]), ("gone", True, ["f9"]), ("none", True, []), ("bad", False, None)],
                                    "key STRING, success BOOLEAN, files ARRAY<STRING>")
    files = spark.createDataFrame([("f1", 1000), ("f2", 999)], "path STRING, size BIGINT")
    failed = {(r.key, r.rule) for r in fl.collection_validate(results, files).where("NOT passed").collect()}
    assert failed == {("small", "files_large_enough"), ("gone", "files_exist"), ("none", "has_files"), ("bad", "success"), ("bad", "has_files")}


def test_incomplete_files(spark):
    names = ["a.docx", "b.crdownload", "c.tmp", "d.part", ".hidden", "x/.hidden", "dir/", "e.part.docx"]
    df = spark.createDataFrame([(n,) for n in names], "path STRING")
    assert [r.path for r in fl.incomplete_files(df).collect()] == ["a.docx", "e.part.docx"]


def test_size_stable(spark):
    seen = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3), ("b", 0, 1), ("b", 0, 2), ("c", 7, 1)], "path STRING, size BIGINT, seen_at INT")
    got = {(r.path, r.seen_at) for r in fl.size_stable(seen).where("stable").collect()}
    assert got == {("a", 2)}


def test_ledger(spark):
    rows = [(1, "s1", 1, "failed"), (2, "s1", 2, "done"), (3, "s2", 1, "failed"), (4, "s2", 2, "failed"), (5, "s3", 1, "done")]
    ledger = spark.createDataFrame(rows, "event_id BIGINT, section_id STRING, ts INT, status STRING")
    assert fl.ledger_summary(ledger).first().asDict() == {"total": 3, "downloaded": 2, "initial_failures": 2, "still_failed": 1}
    final = fl.attempt_number(ledger).where("final_failure").collect()
    assert [(r.event_id, r.attempt) for r in final] == [(4, 2)]


def test_gazetteer(spark):
    places = spark.createDataFrame([(i, i, "Springfield", "us") for i in range(9)] + [(20, 0, " springFIELD ", "us"), (21, 0, "Springfield", "ca")],
                                   "place_id BIGINT, place_rank INT, name STRING, country STRING")
    queries = spark.createDataFrame([(1, " SPRINGFIELD"), (2, "nowhere"), (3, "  "), (4, None)], "query_id BIGINT, query STRING")
    got = [(r.query_id, r.place_id) for r in cat.gazetteer_lookup(queries, places).collect()]
    assert sorted(got, key=repr) == [(1, 0), (1, 1), (1, 2), (1, 20), (1, 3), (2, None)]


def test_unreadable_coordinates(spark):
    df = spark.createDataFrame([("1.5", "x", ["1", "", "3", "4"])], "lat STRING, lon STRING, bbox ARRAY<STRING>")
    assert tuple(cat.parse_coordinates(df).first()) == (1.5, None, [1.0, None, 3.0, 4.0])


def test_two_adjustments_of_one_label_are_an_error(spark):
    label = spark.createDataFrame([("h", *[1.0] * 8)], "pdf_hash STRING, " + ", ".join(f"{c} DOUBLE" for c in CORNER_COLUMNS))
    moves = spark.createDataFrame([("h", 1.0, 1.0), ("h", 2.0, 2.0)], "pdf_hash STRING, dx DOUBLE, dy DOUBLE")
    with pytest.raises(Exception, match="more than one adjustment"):
        op.translate_corners(label, moves).collect()
    assert op.translate_corners(label, moves.limit(1)).count() == 1


def test_label_events_shuffle_no_texts(spark, sf):
    """The same rows as the fixture's SQL, and the hash is taken below the join."""
    ours, plain = label_events(spark, sf), frame(spark, sf, "label_events")
    assert ours.dtypes == plain.dtypes and ours.columns == plain.columns
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))
    tree = ours._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= tree.index("Join") < tree.index("md5")

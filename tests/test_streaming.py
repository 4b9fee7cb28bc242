"""Streams against their batch form, with late and repeated input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotweave.fixtures import frame, table
from plotweave.schemas import CORNER_COLUMNS
from plotweave.streaming import labels as lab
from plotweave.streaming import bursts, landing, snapshots


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


CHANGE = "event_id BIGINT, ts TIMESTAMP, op STRING, pdf_hash STRING, pdf_path STRING, " + ", ".join(f"{c} DOUBLE" for c in CORNER_COLUMNS)


def changes(spark, *events):
    """(event_id, minute, op, hash); the path names the event."""
    return spark.createDataFrame([(i, at(m), op, h, f"p{i}", *([float(i)] * 8)) for i, m, op, h in events], CHANGE)


def current(spark, table_path):
    return {r.pdf_hash: (r.pdf_path, r.created_at, r.updated_at) for r in lab.label_table(spark, table_path).collect()}


A, B, C = "0" * 32, "1" * 32, "2" * 32


def test_older_late_event_cannot_overwrite(spark, tmp_path):
    t = str(tmp_path / "labels")
    lab.apply_batch(changes(spark, (1, 1, "save", A), (3, 3, "save", A), (4, 4, "save", B)), 0, t, t + "_merged", 4)
    lab.apply_batch(changes(spark, (2, 2, "save", A), (5, 5, "save", C)), 1, t, t + "_merged", 4)
    assert current(spark, t) == {A: ("p3", at(3), at(3)), B: ("p4", at(4), at(4)), C: ("p5", at(5), at(5))}


def test_late_save_cannot_undo_a_delete(spark, tmp_path):
    t = str(tmp_path / "labels")
    lab.apply_batch(changes(spark, (1, 1, "save", A)), 0, t, t + "_merged", 4)
    lab.apply_batch(changes(spark, (5, 5, "delete", A)), 1, t, t + "_merged", 4)
    assert current(spark, t) == {}
    lab.apply_batch(changes(spark, (3, 3, "save", A)), 2, t, t + "_merged", 4)
    assert current(spark, t) == {}
    lab.apply_batch(changes(spark, (9, 9, "save", A)), 3, t, t + "_merged", 4)
    assert current(spark, t) == {A: ("p9", at(9), at(9))}


def test_creation_time_survives_updates(spark, tmp_path):
    t = str(tmp_path / "labels")
    lab.apply_batch(changes(spark, (1, 1, "save", A)), 0, t, t + "_merged", 4)
    lab.apply_batch(changes(spark, (2, 7, "save", A)), 1, t, t + "_merged", 4)
    assert current(spark, t) == {A: ("p2", at(1), at(7))}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    t = str(tmp_path / "labels")
    first, second = changes(spark, (1, 1, "save", A), (2, 2, "save", B)), changes(spark, (3, 3, "save", A), (4, 4, "delete", B))
    lab.apply_batch(first, 0, t, t + "_merged", 4)
    lab.apply_batch(second, 1, t, t + "_merged", 4)
    expected = current(spark, t)
    lab.apply_batch(second, 1, t, t + "_merged", 4)
    assert current(spark, t) == expected == {A: ("p3", at(1), at(3))}


def test_interrupted_move_is_repeated_from_the_full_copy(spark, tmp_path):
    """The table loses buckets half-way through a move; repeating the batch restores them."""
    import shutil

    t = str(tmp_path / "labels")
    lab.apply_batch(changes(spark, (1, 1, "save", A), (2, 2, "save", B)), 0, t, t + "_merged", 4)
    second = changes(spark, (3, 3, "save", A), (4, 4, "save", C))
    lab.apply_batch(second, 1, t, t + "_merged", 4)
    expected = current(spark, t)
    bucket = next(p for p in (tmp_path / "labels").iterdir() if p.name.startswith("bucket="))
    shutil.move(str(bucket), str(tmp_path / "lost"))
    lab.apply_batch(second, 1, t, t + "_merged", 4)
    assert current(spark, t) == expected


def test_new_checkpoint_does_not_see_old_copies(spark, tmp_path):
    """Batch numbers start again with a new checkpoint; changes under an old number must not be skipped."""
    t, source = str(tmp_path / "labels"), str(tmp_path / "in")
    for run, event in enumerate([(1, 1, "save", A), (2, 2, "save", B)]):
        changes(spark, event).write.mode("overwrite").parquet(source)
        stream = spark.readStream.schema(CHANGE).parquet(source)
        lab.label_stream_upsert(stream, t, str(tmp_path / f"cp{run}"), buckets=4)
    assert set(current(spark, t)) == {A, B}


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    t = str(tmp_path / "labels")
    hashes = [f"{i:04x}" + "0" * 28 for i in range(4)]
    lab.apply_batch(changes(spark, *[(i, i, "save", h) for i, h in enumerate(hashes)]), 0, t, t + "_merged", 4)
    names = lambda: {p.parent.name: p.name for p in (tmp_path / "labels").glob("bucket=*/*.parquet")}
    before = names()
    lab.apply_batch(changes(spark, (9, 9, "save", hashes[2])), 1, t, t + "_merged", 4)
    after = names()
    assert {b for b in after if after[b] != before[b]} == {"bucket=2"}


def test_stream_equals_batch_in_any_order(spark, sf, tmp_path):
    events = frame(spark, sf, "label_events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(3, F.hash("event_id")).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = lab.label_stream_upsert(stream, str(tmp_path / "t"), str(tmp_path / "cp"), buckets=4)
    assert query.lastProgress["batchId"] >= 2
    from plotweave.operators.labels import latest_label

    expected = {r.pdf_hash: r.pdf_path for r in latest_label(events).where("op = 'save'").collect()}
    assert {h: v[0] for h, v in current(spark, str(tmp_path / "t")).items()} == expected


# --- versions --------------------------------------------------------------------------------------


def seen(labels):
    return {r.pdf_hash: (r.pdf_path, r.created_at, r.updated_at) for r in labels.collect()}


def test_readers_see_whole_versions(spark, tmp_path):
    """A frame read before a commit keeps its version; earlier versions stay readable; no bucket is rewritten in place."""
    t, run = str(tmp_path / "t"), str(tmp_path / "run")
    assert seen(snapshots.snapshot(spark, t)) == {}
    snapshots.commit_batch(changes(spark, (1, 1, "save", A), (2, 2, "save", B)), 0, t, run, 4)
    before = snapshots.snapshot(spark, t)
    snapshots.commit_batch(changes(spark, (3, 3, "save", A), (4, 4, "delete", B), (5, 5, "save", C), (6, 6, "save", None)), 1, t, run, 4)
    first, second = {A: ("p1", at(1), at(1)), B: ("p2", at(2), at(2))}, {A: ("p3", at(1), at(3)), C: ("p5", at(5), at(5))}
    assert seen(before) == seen(snapshots.snapshot(spark, t, 1)) == first
    assert seen(snapshots.snapshot(spark, t)) == seen(snapshots.snapshot(spark, t, 2)) == second
    with pytest.raises(ValueError, match="no version 3"):
        snapshots.snapshot(spark, t, 3)


def test_interrupted_commit_shows_the_old_version(spark, tmp_path, monkeypatch):
    """All files are written, the version is not: readers see the old one, and the repeated batch commits."""
    t, run = str(tmp_path / "t"), str(tmp_path / "run")
    snapshots.commit_batch(changes(spark, (1, 1, "save", A)), 0, t, run, 4)
    batch, whole = changes(spark, (2, 2, "save", A), (3, 3, "save", C)), snapshots._write_new

    def die(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots, "_write_new", die)
    with pytest.raises(RuntimeError, match="lost"):
        snapshots.commit_batch(batch, 1, t, run, 4)
    assert len(list((tmp_path / "t" / "sets").iterdir())) == 2
    assert snapshots.versions(spark, t) == [1]
    assert seen(snapshots.snapshot(spark, t)) == {A: ("p1", at(1), at(1))}
    monkeypatch.setattr(snapshots, "_write_new", whole)
    for _ in range(2):  # the second time the batch is already there
        snapshots.commit_batch(batch, 1, t, run, 4)
    assert snapshots.versions(spark, t) == [1, 2]
    assert seen(snapshots.snapshot(spark, t)) == {A: ("p2", at(1), at(2)), C: ("p3", at(3), at(3))}
    assert len(list((tmp_path / "t" / "sets").iterdir())) == 2


def test_a_version_is_never_replaced(spark, tmp_path):
    path = str(tmp_path / "versions" / "v1.json")
    (tmp_path / "versions").mkdir()
    snapshots._write_new(spark, path, "first")
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots._write_new(spark, path, "second")
    assert open(path).read() == "first"
    assert [p.name for p in (tmp_path / "versions").iterdir() if p.suffix != ".crc"] == ["v1.json"]


def test_old_versions_expire_with_their_files(spark, tmp_path):
    t, run = str(tmp_path / "t"), str(tmp_path / "run")
    hashes = [f"{i:04x}" + "0" * 28 for i in range(3)]
    for i in range(4):
        snapshots.commit_batch(changes(spark, (i, i, "save", hashes[i % 3])), i, t, run, 4, keep=1)
    assert snapshots.versions(spark, t) == [3, 4]
    assert set(seen(snapshots.snapshot(spark, t, 3))) == set(seen(snapshots.snapshot(spark, t))) == set(hashes)
    snapshots.expire(spark, t, keep=0)
    assert snapshots.versions(spark, t) == [4]
    assert len(list((tmp_path / "t" / "sets").iterdir())) == 3
    assert seen(snapshots.snapshot(spark, t))[hashes[0]] == ("p3", at(0), at(3))


def test_versions_know_their_runs_and_buckets(spark, tmp_path):
    """A new checkpoint counts batches from 0 again; another bucket count is refused."""
    t = str(tmp_path / "t")
    for run in ("one", "two"):
        snapshots.commit_batch(changes(spark, (1, 1, "save", A if run == "one" else B)), 0, t, str(tmp_path / run), 4)
    assert set(seen(snapshots.snapshot(spark, t))) == {A, B}
    snapshots.commit_batch(changes(spark, (9, 9, "save", C)), 0, t, str(tmp_path / "one"), 4)
    assert snapshots.versions(spark, t) == [1, 2]
    with pytest.raises(ValueError, match="4 buckets"):
        snapshots.commit_batch(changes(spark, (1, 1, "save", A)), 1, t, str(tmp_path / "one"), 8)


def test_versioned_table_equals_the_overwritten_one(spark, sf, tmp_path):
    events = frame(spark, sf, "label_events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(2, F.hash("event_id")).write.parquet(source)
    for name, run in (("a", lab.label_stream_upsert), ("b", snapshots.label_stream_commit)):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(stream, str(tmp_path / name), str(tmp_path / f"cp-{name}"), buckets=4)
    assert snapshots.versions(spark, str(tmp_path / "b"))[-1] >= 2
    assert seen(snapshots.snapshot(spark, str(tmp_path / "b"))) == current(spark, str(tmp_path / "a"))


# --- windows ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def searches(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value",
        F.concat("event_type", F.col("event_id").cast("string")).alias("query"))


def replay(spark, events, path, watermark_end=True):
    events.repartition(3).write.parquet(path)
    if watermark_end:
        last = events.limit(1).withColumns({"ts": F.lit("2100-01-01").cast("timestamp"), "user_id": F.lit(-1).cast("bigint")})
        last.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def collected(df):
    return sorted(map(tuple, df.where("user_id >= 0").collect()))


def test_bursts_equal_batch(spark, searches, tmp_path):
    stream = landing.search_burst_collapse(replay(spark, searches, str(tmp_path / "in")), "30 minutes", "1 day")
    landing.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = landing.search_burst_collapse(searches, "30 minutes")
    assert batch.where("n_queries > 1").count() > 0
    assert collected(spark.read.parquet(str(tmp_path / "out"))) == collected(batch)


def test_samples_equal_batch(spark, searches, tmp_path):
    stream = landing.position_sampling(replay(spark, searches, str(tmp_path / "in")), "2 hours", "1 day")
    landing.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert collected(spark.read.parquet(str(tmp_path / "out"))) == collected(landing.position_sampling(searches, "2 hours"))


def test_burst_keeps_the_last_query(spark):
    rows = [(1, at(0), 1, "z"), (2, at(1), 1, "zo"), (3, at(2), 1, "zone"), (4, at(30), 1, "map"), (5, at(1), 2, "x")]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, query STRING")
    got = sorted((r.user_id, r.query, r.n_queries) for r in landing.search_burst_collapse(events, "5 minutes").collect())
    assert got == [(1, "map", 1), (1, "zone", 3), (2, "x", 1)]


@pytest.mark.parametrize("salts", [1, 4])
def test_landing_drops_redelivery_over_runs(spark, tmp_path, salts):
    """A second run continues from the checkpoint and still knows what came before."""
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "md5 STRING, ts TIMESTAMP"
    run = lambda: landing.run_to_parquet(
        landing.landing_stream(spark.readStream.schema(schema).parquet(source), ["md5"], "1 hour", salts=salts), out, cp)
    spark.createDataFrame([("a", at(0)), ("a", at(1)), ("b", at(2))], schema).write.parquet(source)
    run()
    spark.createDataFrame([("a", at(5)), ("c", at(6))], schema).write.mode("append").parquet(source)
    run()
    assert sorted(r.md5 for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_another_bucket_count_is_refused(spark, tmp_path):
    """With other buckets a hash would be looked for in the wrong place and end up twice."""
    table, copies = str(tmp_path / "t"), str(tmp_path / "c")
    row = ("e1", "p") + tuple(float(i) for i in range(8))
    columns = "pdf_hash STRING, pdf_path STRING, " + ", ".join(f"{c} DOUBLE" for c in CORNER_COLUMNS)
    changes = spark.createDataFrame([row, (None, *row[1:])], columns).select(
        F.lit(1).cast("bigint").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("save").alias("op"), "*")
    lab.apply_batch(changes, 0, table, copies, buckets=8)
    assert [r.pdf_hash for r in lab.label_table(spark, table).collect()] == ["e1"]
    with pytest.raises(ValueError, match="8 buckets"):
        lab.apply_batch(changes, 1, table, copies, buckets=64)


SEARCH = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, query STRING"


def test_last_burst_comes_out_by_silence(spark, tmp_path):
    """No later event: the pause alone ends a burst, and no state is left. A second run begins anew."""
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    big = 2**62 + 1
    rows = [(3, at(2), big, "zone"), (1, at(0), big, "z"), (2, at(1), big, "zo"), (4, at(30), big, "map"), (5, at(1), None, "x"),
            (None, at(1), None, "w"), (6, at(3), 2, None), (7, None, 2, "no time"), (8, at(6), None, "y")]
    run = lambda: bursts.run_until_idle(bursts.search_idle_collapse(spark.readStream.schema(SEARCH).parquet(source), 300, 0.5), out, cp, 120)
    got = lambda: sorted(map(str, ((r.user_id, r.burst_start, r["query"], r.n_queries) for r in spark.read.parquet(out).collect())))
    spark.createDataFrame(rows, SEARCH).repartition(3).write.parquet(source)
    query = run()
    first = [(big, at(0), "zone", 3), (big, at(30), "map", 1), (None, at(1), "x", 2), (None, at(6), "y", 1), (2, at(3), None, 1)]
    assert got() == sorted(map(str, first))
    assert [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]] == [0]
    spark.createDataFrame([(9, at(31), big, "maps")], SEARCH).write.mode("append").parquet(source)
    run()
    assert got() == sorted(map(str, [*first, (big, at(31), "maps", 1)]))


def test_open_burst_waits_for_its_user(spark, tmp_path):
    """Micro-batches within the pause continue a burst; an earlier burst comes out when a later one begins."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, at(0), 1, "z")], [(2, at(1), 1, "zo"), (3, at(60), 1, "m")], [(4, at(61), 1, "ma"), (5, at(0), 2, "x")]):
        spark.createDataFrame(rows, SEARCH).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SEARCH).option("maxFilesPerTrigger", 1).parquet(source)
    bursts.run_until_idle(bursts.search_idle_collapse(stream, 300, 15), out, str(tmp_path / "cp"), 120)
    got = sorted((r.user_id, r["query"], r.n_queries) for r in spark.read.parquet(out).collect())
    assert got == [(1, "ma", 2), (1, "zo", 2), (2, "x", 1)]


def test_parts_of_bursts_join_in_any_order(spark, searches):
    """Merging parts dealt at random gives the bursts of all events at once."""
    import numpy as np
    import pandas as pd

    events = searches.select(F.col("user_id").cast("string").alias("user"), F.unix_micros("ts").alias("first_us"), F.unix_micros("ts").alias("last_us"),
                             "event_id", "query", F.lit(1).alias("n_queries")).toPandas()
    gap = 4 * 3600 * 10**6
    dealt = np.random.default_rng(1).integers(0, 7, len(events))
    parts = pd.concat([bursts.merge_parts(events[dealt == i], gap) for i in range(7)])
    got = sorted((r.user, r.first_us, r.query, r.n_queries) for r in bursts.merge_parts(parts, gap).itertuples())
    expected = landing.search_burst_collapse(searches, "4 hours").select(F.col("user_id").cast("string"), F.unix_micros("burst_start"), "query", "n_queries")
    assert got == sorted(map(tuple, expected.collect()))

"""A label table whose readers see whole versions, and can read earlier ones.

Every micro-batch writes the buckets it touches as a new set of files that is never changed afterwards. A version is
one small file that names the files of every bucket; it is moved into place last, and a version that exists is never
replaced. Readers take the highest version there is. A run that dies leaves files no version names.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plotweave.operators.labels import latest_label
from plotweave.streaming.labels import BUCKETS, STATE_SCHEMA, _bucket, merge_changes

#: Versions that stay readable behind the current one.
KEEP = 20

FILE_SCHEMA = STATE_SCHEMA.removesuffix(", bucket INT")
VERSION_SCHEMA = (
    "version BIGINT, buckets INT, done ARRAY<STRUCT<run: STRING, batch_id: BIGINT>>, files ARRAY<STRUCT<bucket: INT, folder: STRING>>"
)


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    jvm_path: JavaObject = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    jvm_path, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(jvm_path)) if fs.exists(jvm_path) else []


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """A file with the text, complete from the moment it is there; an error if there is one already."""
    target, _ = _path(spark, path)
    aside, fs = _path(spark, f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(text.encode())
    out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), spark._sc._gateway.new_array(options, 0))
    finally:
        fs.delete(aside, False)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the readable versions, ascending; there are at most as many as are kept."""
    return [int(name[1:-5]) for name in _names(spark, f"{table}/versions") if name.startswith("v")]


def _version(spark: SparkSession, table: str, number: int) -> dict:
    return spark.read.schema(VERSION_SCHEMA).json(f"{table}/versions/v{number:012d}.json").first().asDict(recursive=True)


def _latest(spark: SparkSession, table: str, buckets: int) -> dict:
    known = versions(spark, table)
    if not known:
        return {"version": 0, "buckets": buckets, "done": [], "files": []}
    latest = _version(spark, table, known[-1])
    if latest["buckets"] != buckets:
        raise ValueError(f"{table} has {latest['buckets']} buckets, not {buckets}")
    return latest


def _read(spark: SparkSession, table: str, files: list[dict]) -> DataFrame:
    paths = [f"{table}/sets/{f['folder']}/bucket={f['bucket']}" for f in files]
    return spark.read.schema(FILE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], FILE_SCHEMA)


def snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Labels of one version, by default the current one; a table without versions is empty.

    The files are fixed when this is called: later commits do not change what the result reads, until the version expires.
    """
    known = versions(spark, table)
    if version is not None and version not in known:
        raise ValueError(f"{table} has no version {version}")
    files = _version(spark, table, version or known[-1])["files"] if known else []
    return _read(spark, table, files).where(~F.col("deleted")).drop("deleted", "event_id")


def _run_id(spark: SparkSession, run: str) -> str:
    """Name of one run of batch numbers, kept with the stream's checkpoint: a new checkpoint is a new run."""
    if "run.json" not in _names(spark, run):
        _write_new(spark, f"{run}/run.json", json.dumps({"run": uuid.uuid4().hex}))
    return spark.read.schema("run STRING").json(f"{run}/run.json").first()["run"]


def commit_batch(changes: DataFrame, batch_id: int, table: str, run: str, buckets: int = BUCKETS, keep: int = KEEP) -> None:
    """Merge one micro-batch into a new version; a batch that is already in the table changes nothing.

    Reads and writes only the buckets the batch touches. Changes without a hash name no label and are left out; a batch
    without any other makes no version. ``run`` is a folder that lives and dies with the stream's checkpoint.
    """
    spark, run_id = changes.sparkSession, _run_id(changes.sparkSession, run)
    latest = _latest(spark, table, buckets)
    done = {d["run"]: d["batch_id"] for d in latest["done"]}
    if done.get(run_id, -1) >= batch_id:
        return
    last = latest_label(changes.where(F.col("pdf_hash").isNotNull())).withColumn("bucket", _bucket(buckets)).persist()
    try:
        touched = {r[0] for r in last.select("bucket").distinct().collect()}  # at most one number per bucket
        if not touched:
            return
        files = {f["bucket"]: f["folder"] for f in latest["files"]}
        state = _read(spark, table, [f for f in latest["files"] if f["bucket"] in touched])
        folder = f"{run_id}-{batch_id}-{uuid.uuid4().hex[:8]}"
        merged = merge_changes(state, last.drop("bucket"), buckets)
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{table}/sets/{folder}")
    finally:
        last.unpersist()
    files |= dict.fromkeys(touched, folder)
    done[run_id] = batch_id
    number = latest["version"] + 1
    _write_new(spark, f"{table}/versions/v{number:012d}.json", json.dumps({
        "version": number, "buckets": buckets,
        "done": [{"run": r, "batch_id": b} for r, b in done.items()],
        "files": [{"bucket": b, "folder": f} for b, f in sorted(files.items())],
    }))
    expire(spark, table, keep)


def expire(spark: SparkSession, table: str, keep: int = KEEP) -> None:
    """Remove all but the current version and ``keep`` before it, and files that no version names.

    Only the writer may call it: files of a batch that is being written are named by no version yet.
    """
    known = versions(spark, table)
    for number in known[:-1 - keep]:
        path, fs = _path(spark, f"{table}/versions/v{number:012d}.json")
        fs.delete(path, False)
    kept = [f"{table}/versions/v{number:012d}.json" for number in known[-1 - keep:]]
    files = spark.read.schema(VERSION_SCHEMA).json(kept).select(F.inline("files")).distinct() if kept else None
    named = {(f["folder"], f"bucket={f['bucket']}") for f in files.collect()} if kept else set()  # at most a bucket per version kept
    for folder in _names(spark, f"{table}/sets"):
        inside = [n for n in _names(spark, f"{table}/sets/{folder}") if n.startswith("bucket=")]
        gone = [n for n in inside if (folder, n) not in named]
        for path in ([folder] if len(gone) == len(inside) else [f"{folder}/{n}" for n in gone]):
            old, fs = _path(spark, f"{table}/sets/{path}")
            fs.delete(old, True)


def label_stream_commit(stream: DataFrame, table: str, checkpoint: str, timeout: int = 600,
                        buckets: int = BUCKETS, keep: int = KEEP) -> StreamingQuery:
    """Merge a stream of saves and deletes into a versioned table, one version per micro-batch that changes something.

    One writer per table. Of two that commit the same version the later fails, and its stream repeats the batch on top of the other's.
    """
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: commit_batch(df, batch_id, table, f"{checkpoint}/run", buckets, keep))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"label stream into {table} did not finish in {timeout} s")
    return query

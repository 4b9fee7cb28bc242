"""Streams: each query replays the events as a stream and returns what the sink holds."""

from pyspark.sql import functions as F

from plotweave.fixtures import label_events, table
from plotweave.queries.registry import query
from plotweave.session import staging_path
from plotweave.streaming import labels as lab
from plotweave.streaming import bursts, landing, snapshots

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE"
FLUSH_USER = -1


def event_stream(spark, sf):
    """The events table as a stream, followed by one event far in the future.

    A watermark only passes windows older than the newest event; the last event lets all others out and
    never leaves the state itself.
    """
    path = staging_path(spark, "event-stream")
    timed = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    timed.write.parquet(path)
    end = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"),
        F.lit(FLUSH_USER).cast("bigint").alias("user_id"), F.lit("flush").alias("event_type"), F.lit(0.0).alias("value"),
    )
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def _run(spark, stream):
    path = staging_path(spark, "stream-out")
    landing.run_to_parquet(stream, path, staging_path(spark, "stream-state"))
    return spark.read.parquet(path)


@query("landing_stream", "SELECT DISTINCT md5(CAST(user_id AS VARCHAR) || event_type) AS md5 FROM {events}")
def _(spark, sf):
    """The same content is delivered many times; it lands once."""
    content = F.md5(F.concat(F.col("user_id").cast("string"), "event_type"))
    arrivals = event_stream(spark, sf).where(F.col("user_id") != FLUSH_USER).select(content.alias("md5"), "ts")
    return _run(spark, landing.landing_stream(arrivals, ["md5"], "60 days", salts=8)).select("md5")


_BURSTS = """
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS burst_us, arg_max(query, ts) AS query, count(*) AS n_queries
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst
          FROM (SELECT *, event_type || CAST(event_id AS VARCHAR) AS query,
                       CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh
                FROM {events}) AS g) AS b GROUP BY user_id, burst"""


@query("search_burst_collapse", _BURSTS)
def _(spark, sf):
    typed = event_stream(spark, sf).withColumn("query", F.concat("event_type", F.col("event_id").cast("string")))
    collapsed = _run(spark, landing.search_burst_collapse(typed, "4 hours", "1 day"))
    return collapsed.select("user_id", F.unix_micros("burst_start").alias("burst_us"), "query", "n_queries")


@query("search_idle_collapse", _BURSTS)
def _(spark, sf):
    """The same bursts from a stream without a last event: the pause alone lets the last burst of every user out."""
    path, out = staging_path(spark, "searches"), staging_path(spark, "stream-out")
    table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat("event_type", F.col("event_id").cast("string")).alias("query")
    ).write.parquet(path)
    typed = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, query STRING").parquet(path)
    bursts.run_until_idle(bursts.search_idle_collapse(typed, 4 * 3600, 1), out, staging_path(spark, "stream-state"))
    return spark.read.parquet(out).select("user_id", F.unix_micros("burst_start").alias("burst_us"), "query", "n_queries")


@query("position_sampling", """
    SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS slot_s, arg_max(value, event_id) AS value
    FROM {events} GROUP BY user_id, floor(epoch(ts) / 21600)""")
def _(spark, sf):
    slots = _run(spark, landing.position_sampling(event_stream(spark, sf), "6 hours", "1 day"))
    return slots.select("user_id", F.unix_timestamp("slot_start").alias("slot_s"), "value")


@query("label_stream_upsert", """
    SELECT pdf_hash, pdf_path, top_left_lng, event_us FROM (
        SELECT *, CAST(epoch_us(ts) AS BIGINT) AS event_us, row_number() OVER (PARTITION BY pdf_hash ORDER BY ts DESC, event_id DESC) AS rn FROM {label_events} AS e) AS r
    WHERE rn = 1 AND op = 'save'""")
def _(spark, sf):
    """Label events in shuffled order; the stored table keeps the last state of each hash."""
    source, store = staging_path(spark, "label-events"), staging_path(spark, "label-table")
    events = label_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(F.xxhash64("event_id")).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    lab.label_stream_upsert(stream, store, staging_path(spark, "label-state"), buckets=8)
    current = lab.label_table(spark, store)
    return current.select("pdf_hash", "pdf_path", "top_left_lng", F.unix_micros("updated_at").alias("event_us"))


@query("label_snapshots", """
    SELECT version, pdf_hash, pdf_path, event_us FROM (
        SELECT v.version, e.*, CAST(epoch_us(ts) AS BIGINT) AS event_us,
               row_number() OVER (PARTITION BY v.version, pdf_hash ORDER BY ts DESC, event_id DESC) AS rn
        FROM {label_events} AS e JOIN (VALUES (1), (2)) AS v(version) ON e.event_id % 2 < v.version) AS r
    WHERE rn = 1 AND op = 'save'""")
def _(spark, sf):
    """Label events arrive in two runs of one stream; each run's version stays readable."""
    source, store, state = (staging_path(spark, f"label-{name}") for name in ("arrivals", "versions", "progress"))
    events = label_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        snapshots.label_stream_commit(spark.readStream.schema(events.schema).parquet(source), store, state, buckets=8)
    first, second = (
        snapshots.snapshot(spark, store, n).select(F.lit(n).alias("version"), "pdf_hash", "pdf_path", F.unix_micros("updated_at").alias("event_us"))
        for n in (1, 2))
    return first.unionByName(second)

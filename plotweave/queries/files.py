"""File sightings, ledgers and collection checks."""

from pyspark.sql import functions as F

from plotweave.fixtures import frame, table
from plotweave.operators import catalog as cat
from plotweave.operators import files as op
from plotweave.queries.registry import query

_DONE = r"NOT regexp_matches(path, '\.(crdownload|tmp|part)$') AND NOT path LIKE 'downloads/.%' AND NOT path LIKE '%/'"


@query("incomplete_files", f"SELECT event_id, path FROM {{sightings}} AS s WHERE {_DONE}")
def _(spark, sf):
    return op.incomplete_files(frame(spark, sf, "sightings")).select("event_id", "path")


@query("modified_since", """
    SELECT event_id, path FROM {sightings} AS s WHERE mtime > TIMESTAMP '2024-01-15 12:00:00' AND path LIKE '%.docx'""")
def _(spark, sf):
    since = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return op.modified_since(frame(spark, sf, "sightings"), since, r"\.docx$").select("event_id", "path")


@query("latest_file", """
    SELECT folder, path, size FROM (
        SELECT event_id % 50 AS folder, path, size, row_number() OVER (PARTITION BY event_id % 50 ORDER BY mtime DESC, path DESC) AS rn FROM {sightings} AS s) AS r
    WHERE rn = 1""")
def _(spark, sf):
    files = frame(spark, sf, "sightings").withColumn("folder", F.col("event_id") % 50)
    return op.latest_file(files, "folder").select("folder", "path", "size")


@query("new_files", """
    SELECT DISTINCT path FROM {sightings} AS s WHERE path NOT IN (SELECT path FROM {sightings} AS b WHERE seen_at < TIMESTAMP '2024-01-02 00:00:00')""")
def _(spark, sf):
    seen = frame(spark, sf, "sightings")
    before = seen.where(F.col("seen_at") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return cat.new_files(seen.select("path").distinct(), before)


@query("size_stable", """
    SELECT event_id, coalesce(size > 0 AND size = lag(size) OVER (PARTITION BY path ORDER BY seen_at, event_id), FALSE) AS stable
    FROM (SELECT event_id, path, seen_at, size % 5 AS size FROM {sightings} AS s) AS x""")
def _(spark, sf):
    seen = frame(spark, sf, "sightings").select("event_id", "path", "seen_at", (F.col("size") % 5).alias("size"))
    return op.size_stable(seen, tie="event_id").select("event_id", "stable")


@query("attempt_number", """
    SELECT event_id, section_id, attempt, status = 'failed' AND attempt >= 2 AS final_failure
    FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY ts, event_id) AS attempt FROM {ledger} AS l) AS n""")
def _(spark, sf):
    return op.attempt_number(frame(spark, sf, "ledger"), tie="event_id").select("event_id", "section_id", "attempt", "final_failure")


@query("ledger_summary", """
    SELECT count(*) AS total, count(*) FILTER (WHERE done) AS downloaded, count(*) FILTER (WHERE first = 'failed') AS initial_failures,
           count(*) FILTER (WHERE NOT done) AS still_failed
    FROM (SELECT section_id, bool_or(status <> 'failed') AS done, arg_min(status, (ts, event_id)) AS first FROM {ledger} AS l GROUP BY section_id) AS s"""
       .replace("arg_min(status, (ts, event_id))", "arg_min(status, event_id)"))
def _(spark, sf):
    return op.ledger_summary(frame(spark, sf, "ledger"))


@query("collection_validate", """
    WITH inv AS (SELECT path, max(size) AS size FROM {sightings} AS s WHERE path LIKE '%.docx' GROUP BY path),
         res AS (SELECT user_id AS key, user_id % 5 <> 0 AS success FROM {events} GROUP BY user_id),
         lst AS (SELECT DISTINCT user_id AS key, s.path FROM {events} AS e JOIN {sightings} AS s USING (event_id) WHERE user_id % 9 <> 0 AND (s.path LIKE '%.docx' OR user_id % 4 = 0)),
         chk AS (SELECT r.key, success, count(l.path) AS n, count(*) FILTER (WHERE l.path IS NOT NULL AND i.size IS NULL) AS missing,
                        count(*) FILTER (WHERE i.size < 1000) AS small
                 FROM res AS r LEFT JOIN lst AS l USING (key) LEFT JOIN inv AS i ON i.path = l.path GROUP BY r.key, success)
    SELECT key, 'success' AS rule, success AS passed FROM chk UNION ALL SELECT key, 'has_files', n > 0 FROM chk
    UNION ALL SELECT key, 'files_exist', missing = 0 FROM chk UNION ALL SELECT key, 'files_large_enough', small = 0 FROM chk""")
def _(spark, sf):
    seen = frame(spark, sf, "sightings")
    owners = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"))
    owned = owners.join(seen, "event_id")
    listed = (F.col("key") % 9 != 0) & (F.endswith("path", F.lit(".docx")) | (F.col("key") % 4 == 0))
    results = owned.groupBy("key").agg(F.collect_set(F.when(listed, F.col("path"))).alias("files"))
    results = results.withColumn("success", F.col("key") % 5 != 0)
    inventory = seen.where(F.endswith("path", F.lit(".docx"))).groupBy("path").agg(F.max("size").alias("size"))
    return op.collection_validate(results, inventory)

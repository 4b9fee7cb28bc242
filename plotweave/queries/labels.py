"""Georeference labels."""

import hashlib


from pyspark.sql import functions as F

from plotweave.fixtures import frame, geolabels, label_events, table
from plotweave.functions import geometry as geo
from plotweave.operators import catalog as cat
from plotweave.operators import files as fl
from plotweave.operators import labels as op
from plotweave.queries.registry import query
from plotweave.schemas import CORNER_COLUMNS, CORNERS
from plotweave.session import staging_path
from plotweave.sources import landed

_CORNERS = ", ".join(CORNER_COLUMNS)


def _catalog(spark, sf):
    return cat.catalog(frame(spark, sf, "manifest"))


def _epoch(column):
    """Seconds since 1970 of a timestamp without zone."""
    return F.unix_timestamp(F.col(column).cast("timestamp")).alias(column)


@query("coverage_by_place", """
    SELECT state, city, count(*) AS documents, count(*) FILTER (WHERE hash IN (SELECT pdf_hash FROM {geolabels} AS l)) AS labeled,
           CAST(GROUPING(state, city) AS BIGINT) AS level
    FROM {catalog} AS c GROUP BY ROLLUP (state, city)""")
def _(spark, sf):
    covered = op.coverage_by_place(_catalog(spark, sf), geolabels(spark, sf))
    return covered.withColumn("level", F.col("level").cast("bigint"))


@query("labels_scan", f"SELECT pdf_hash, {_CORNERS}, created_s, updated_s FROM {{geolabels}} AS l")
def _(spark, sf):
    path = staging_path(spark, "labels")
    geolabels(spark, sf).write.parquet(path)
    stored = landed.labels_scan(spark, path)
    return stored.select("pdf_hash", *CORNER_COLUMNS, _epoch("created_at").alias("created_s"), _epoch("updated_at").alias("updated_s"))


@query("label_by_hash", f"SELECT pdf_hash, {_CORNERS} FROM {{geolabels}} AS l WHERE pdf_hash = md5('orphan3')")
def _(spark, sf):
    return op.label_by_hash(geolabels(spark, sf), hashlib.md5(b"orphan3").hexdigest()).select("pdf_hash", *CORNER_COLUMNS)


@query("labels_newest_first", "SELECT pdf_hash, updated_s FROM {geolabels} AS l ORDER BY updated_s DESC, pdf_hash")
def _(spark, sf):
    return op.labels_newest_first(geolabels(spark, sf)).select("pdf_hash", _epoch("updated_at").alias("updated_s"))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_hash ORDER BY ts DESC, event_id DESC) AS rn FROM {label_events} AS e) AS r WHERE rn = 1)"


@query("latest_label", f"SELECT pdf_hash, event_id, op, pdf_path, {_CORNERS} FROM {_LATEST} AS n")
def _(spark, sf):
    return op.latest_label(label_events(spark, sf)).select("pdf_hash", "event_id", "op", "pdf_path", *CORNER_COLUMNS)


@query("label_upsert", """
    SELECT pdf_hash, coalesce(n.pdf_path, l.pdf_path) AS pdf_path,
           """ + ", ".join(f"coalesce(n.{c}, l.{c}) AS {c}" for c in CORNER_COLUMNS) + """,
           coalesce(l.created_s, CAST(floor(epoch(n.ts)) AS BIGINT)) AS created_s, coalesce(CAST(floor(epoch(n.ts)) AS BIGINT), l.updated_s) AS updated_s
    FROM {geolabels} AS l FULL JOIN (SELECT * FROM """ + _LATEST + """ AS x WHERE op = 'save') AS n USING (pdf_hash)""")
def _(spark, sf):
    changes = op.latest_label(label_events(spark, sf)).where("op = 'save'")
    merged = op.label_upsert(geolabels(spark, sf), changes)
    return merged.select(
        "pdf_hash", "pdf_path", *CORNER_COLUMNS, _epoch("created_at").alias("created_s"), _epoch("updated_at").alias("updated_s")
    )


@query("label_delete", f"""
    SELECT pdf_hash FROM {{geolabels}} AS l WHERE pdf_hash NOT IN (SELECT pdf_hash FROM {_LATEST} AS n WHERE op = 'delete')""")
def _(spark, sf):
    deleted = op.latest_label(label_events(spark, sf)).where("op = 'delete'")
    return op.label_delete(geolabels(spark, sf), deleted).select("pdf_hash")


@query("label_status", """
    SELECT hash, path, hash IN (SELECT pdf_hash FROM {geolabels} AS l) AS is_labeled FROM {catalog} AS c""")
def _(spark, sf):
    return op.label_status(_catalog(spark, sf), geolabels(spark, sf)).select("hash", "path", "is_labeled")


@query("unlabeled_documents", """
    SELECT hash, path FROM {catalog} AS c WHERE hash NOT IN (SELECT pdf_hash FROM {geolabels} AS l)""")
def _(spark, sf):
    return op.unlabeled_documents(_catalog(spark, sf), geolabels(spark, sf)).select("hash", "path")


@query("label_progress", """
    SELECT count(*) AS total, (SELECT count(*) FROM {geolabels} AS l) AS labeled_total,
           count(*) FILTER (WHERE hash IN (SELECT pdf_hash FROM {geolabels} AS l)) AS labeled_in_catalog FROM {catalog} AS c""")
def _(spark, sf):
    return op.label_progress(_catalog(spark, sf), geolabels(spark, sf))


@query("corners_nest", """
    SELECT pdf_hash, top_left_lng AS tl_lng, bottom_right_lat AS br_lat,
           strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS created_at FROM {geolabels} AS l""")
def _(spark, sf):
    nested = op.labels_nested(geolabels(spark, sf))
    return nested.select(
        "pdf_hash", F.col("corners.topLeft.lng").alias("tl_lng"), F.col("corners.bottomRight.lat").alias("br_lat"), "created_at"
    )


@query("corners_flatten", f"SELECT pdf_hash, pdf_path, {_CORNERS} FROM {{geolabels}} AS l")
def _(spark, sf):
    return op.labels_flat(op.labels_nested(geolabels(spark, sf)))


@query("corners_to_ring", "SELECT pdf_hash, k AS vertex_no, " + ", ".join(
    "CASE k " + " ".join(f"WHEN {i} THEN {c}_{axis}" for i, c in enumerate(CORNERS)) + f" END AS {axis}" for axis in ("lng", "lat")
) + " FROM {geolabels} AS l, (VALUES (0), (1), (2), (3)) AS v(k)")
def _(spark, sf):
    rings = geolabels(spark, sf).select("pdf_hash", F.posexplode(geo.corners_to_ring(geo.corners_nest())).alias("vertex_no", "v"))
    return rings.select("pdf_hash", "vertex_no", F.col("v")[0].alias("lng"), F.col("v")[1].alias("lat"))


@query("labels_as_map", "SELECT pdf_hash, pdf_path, top_left_lng FROM {geolabels} AS l")
def _(spark, sf):
    maps = op.labels_as_map(geolabels(spark, sf))
    entries = maps.select(F.explode("labels").alias("pdf_hash", "label"))
    return entries.select("pdf_hash", "label.pdf_path", F.col("label.corners.topLeft.lng").alias("top_left_lng"))


@query("round_corners", "SELECT pdf_hash, " + ", ".join(f"round({c} + 0.1234567e0, 6) AS {c}" for c in CORNER_COLUMNS) + " FROM {geolabels} AS l")
def _(spark, sf):
    shifted = geolabels(spark, sf).withColumns({c: F.col(c) + 0.1234567 for c in CORNER_COLUMNS})
    return op.round_corners(shifted).select("pdf_hash", *CORNER_COLUMNS)


_LNGS = ", ".join(f"{c}_lng" for c in CORNERS)
_LATS = ", ".join(f"{c}_lat" for c in CORNERS)


@query("corners_bbox", f"""
    SELECT pdf_hash, least({_LNGS}) AS west, least({_LATS}) AS south, greatest({_LNGS}) AS east, greatest({_LATS}) AS north
    FROM {{geolabels}} AS l""")
def _(spark, sf):
    return op.corners_bbox(geolabels(spark, sf))


@query("label_extent", f"""
    SELECT substr(pdf_hash, 1, 1) AS part, min(least({_LNGS})) AS west, min(least({_LATS})) AS south,
           max(greatest({_LNGS})) AS east, max(greatest({_LATS})) AS north FROM {{geolabels}} AS l GROUP BY substr(pdf_hash, 1, 1)""")
def _(spark, sf):
    return op.corners_bbox(geolabels(spark, sf).withColumn("part", F.substring("pdf_hash", 1, 1)), by=["part"])


@query("corners_centroid", "SELECT pdf_hash, " + ", ".join(
    "(" + " + ".join(f"{c}_{axis}" for c in CORNERS) + f") / 4 AS center_{axis}" for axis in ("lng", "lat")
) + " FROM {geolabels} AS l")
def _(spark, sf):
    return op.with_centroid(geolabels(spark, sf)).select("pdf_hash", "center_lng", "center_lat")


@query("unique_hash_check", """
    SELECT 'labels' AS key, rule, violations = 0 AS passed, violations FROM (
        SELECT 'hash_present' AS rule, count(*) FILTER (WHERE pdf_hash IS NULL) AS violations FROM {label_events} AS e
        UNION ALL SELECT 'hash_unique', count(*) FROM (SELECT pdf_hash FROM {label_events} AS e GROUP BY pdf_hash HAVING count(*) > 1) AS d
        UNION ALL SELECT 'corners_present', count(*) FILTER (WHERE top_left_lng IS NULL OR top_left_lat IS NULL) FROM {label_events} AS e) AS r""")
def _(spark, sf):
    return fl.unique_hash_check(label_events(spark, sf))


# --- bulk corrections ------------------------------------------------------------------------------


def _rounded(df):
    return df.select("pdf_hash", *[F.round(c, 6).alias(c) for c in CORNER_COLUMNS])


@query("translate_corners", "SELECT pdf_hash, " + ", ".join(
    f"CASE WHEN d % 2 = 0 THEN {c}_{axis} + {shift} ELSE {c}_{axis} END AS {c}_{axis}"
    for c in CORNERS for axis, shift in (("lng", "0.01e0"), ("lat", "-0.02e0"))
) + " FROM {geolabels} AS l")
def _(spark, sf):
    moves = frame(spark, sf, "geolabels").where("d % 2 = 0").select("pdf_hash", F.lit(0.01).alias("dx"), F.lit(-0.02).alias("dy"))
    return op.translate_corners(geolabels(spark, sf), moves).select("pdf_hash", *CORNER_COLUMNS)


# The dragged corner is the bottom right one, so the top left corner is fixed.
_SCALE = """sqrt(power(to_lng - top_left_lng, 2) + power(to_lat - top_left_lat, 2)) /
            sqrt(power(bottom_right_lng - top_left_lng, 2) + power(bottom_right_lat - top_left_lat, 2))"""


@query("scale_corners", "SELECT pdf_hash, " + ", ".join(
    f"round(top_left_{axis} + ({c}_{axis} - top_left_{axis}) * f, 6) AS {c}_{axis}" for c in CORNERS for axis in ("lng", "lat")
) + f" FROM (SELECT *, {_SCALE} AS f FROM (SELECT *, top_left_lng + 0.3e0 AS to_lng, top_left_lat - 0.2e0 AS to_lat FROM {{geolabels}} AS l) AS m) AS s")
def _(spark, sf):
    scales = geolabels(spark, sf).select(
        "pdf_hash", F.lit("bottom_right").alias("handle"),
        (F.col("top_left_lng") + 0.3).alias("to_lng"), (F.col("top_left_lat") - 0.2).alias("to_lat"),
    )
    return _rounded(op.scale_corners(geolabels(spark, sf), scales))


_CENTER = ", ".join("(" + " + ".join(f"{c}_{axis}" for c in CORNERS) + f") / 4 AS c{axis}" for axis in ("lng", "lat"))


@query("rotate_corners", "SELECT pdf_hash, " + ", ".join(
    f"round(clng + ({c}_lng - clng) * cos(a) - ({c}_lat - clat) * sin(a), 6) AS {c}_lng, "
    f"round(clat + ({c}_lng - clng) * sin(a) + ({c}_lat - clat) * cos(a), 6) AS {c}_lat" for c in CORNERS
) + f" FROM (SELECT *, {_CENTER}, CAST(d % 10 AS DOUBLE) / 10 AS a FROM {{geolabels}} AS l) AS m")
def _(spark, sf):
    angles = frame(spark, sf, "geolabels").select("pdf_hash", ((F.col("d") % 10).cast("double") / 10).alias("angle"))
    return _rounded(op.rotate_corners(geolabels(spark, sf), angles))


def _sheet_points(spark, sf):
    """Two points per catalogued map sheet."""
    docs = table(spark, sf, "documents").select(F.md5("text").alias("pdf_hash"), "doc_id")
    return docs.select("pdf_hash", "doc_id", F.explode(F.array(F.lit(100.0), F.lit(750.0))).alias("px")).withColumn(
        "py", (F.col("doc_id") % 500).cast("double"))


def _blend(axis):
    return (f"round((1 - v) * ((1 - u) * top_left_{axis} + u * top_right_{axis}) + "
            f"v * ((1 - u) * bottom_left_{axis} + u * bottom_right_{axis}), 6)")


@query("pixel_to_geo", f"""
    SELECT doc_id, px, {_blend('lng')} AS lng, {_blend('lat')} AS lat
    FROM (SELECT md5(text) AS pdf_hash, doc_id, px, px / 997e0 AS u, CAST(doc_id % 500 AS DOUBLE) / 491e0 AS v
          FROM {{documents}}, (VALUES (100e0), (750e0)) AS x(px)) AS p JOIN {{geolabels}} AS l USING (pdf_hash)""")
def _(spark, sf):
    located = op.pixel_to_geo(_sheet_points(spark, sf), geolabels(spark, sf), 997, 491)
    return located.select("doc_id", "px", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query("pixel_to_geo_hot", f"""
    SELECT doc_id, px, {_blend('lng')} AS lng, {_blend('lat')} AS lat
    FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN (SELECT min(pdf_hash) FROM {{geolabels}} AS g) ELSE md5(text) END AS pdf_hash,
                 doc_id, px, px / 997e0 AS u, CAST(doc_id % 500 AS DOUBLE) / 491e0 AS v
          FROM {{documents}}, (VALUES (100e0), (750e0)) AS x(px)) AS p JOIN {{geolabels}} AS l USING (pdf_hash)""")
def _(spark, sf):
    sheets = geolabels(spark, sf)
    one = sheets.agg(F.min("pdf_hash").alias("_one"))
    # A third of all points lie on one sheet, which a low ``hot_rows`` splits over several tasks.
    points = _sheet_points(spark, sf).join(F.broadcast(one)).withColumn(
        "pdf_hash", F.when(F.col("doc_id") % 3 == 0, F.col("_one")).otherwise(F.col("pdf_hash"))).drop("_one")
    located = op.pixel_to_geo(points, sheets, 997, 491, hot_rows=50)
    return located.select("doc_id", "px", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


_WORLD = 512 * 2**10


def _mercator(lng, lat):
    x = f"({lng} + 180) / 360 * {_WORLD}e0"
    y = f"(180 - 180 / pi() * ln(tan(pi() / 4 + {lat} * pi() / 360))) / 360 * {_WORLD}e0"
    return x, y


_MX, _MY = _mercator("top_left_lng", "top_left_lat")
_CX, _CY = _mercator("-85.8e0", "33.7e0")


@query("project_mercator", f"""
    SELECT pdf_hash, round({_MX} - ({_CX}) + 400, 3) AS x, round({_MY} - ({_CY}) + 300, 3) AS y FROM {{geolabels}} AS l""")
def _(spark, sf):
    at = geo.project_mercator(F.col("top_left_lng"), F.col("top_left_lat"), 10, (-85.8, 33.7), (800, 600))
    return geolabels(spark, sf).select("pdf_hash", F.round(at.x, 3).alias("x"), F.round(at.y, 3).alias("y"))


@query("unproject_mercator", "SELECT pdf_hash, round(top_left_lng, 6) AS lng, round(top_left_lat, 6) AS lat FROM {geolabels} AS l")
def _(spark, sf):
    """There and back again."""
    view = {"zoom": 10, "center": (-85.8, 33.7), "viewport": (800, 600)}
    there = geolabels(spark, sf).withColumn("at", geo.project_mercator(F.col("top_left_lng"), F.col("top_left_lat"), **view))
    back = there.withColumn("at", geo.unproject_mercator(F.col("at.x"), F.col("at.y"), **view))
    return back.select("pdf_hash", F.round("at.lng", 6).alias("lng"), F.round("at.lat", 6).alias("lat"))


@query("tile_key", f"""
    SELECT pdf_hash, 14 AS z, CAST(floor(({_MX}) / {_WORLD} * {2**14}) AS BIGINT) AS x, CAST(floor(({_MY}) / {_WORLD} * {2**14}) AS BIGINT) AS y
    FROM {{geolabels}} AS l""")
def _(spark, sf):
    tile = geo.tile_key(F.col("top_left_lng"), F.col("top_left_lat"), 14)
    return geolabels(spark, sf).select("pdf_hash", tile.alias("t")).select("pdf_hash", "t.*")



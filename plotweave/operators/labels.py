"""Georeference labels: four corners per document hash, kept by merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions.geometry import bilinear, corners_centroid, corners_flatten, corners_nest, round_corner
from plotweave.plans.skew import HOT_ROWS, missing_from, salted_join
from plotweave.schemas import CORNER_COLUMNS

LABEL_PAYLOAD = ("pdf_path", *CORNER_COLUMNS)


def label_by_hash(labels: DataFrame, pdf_hash: str) -> DataFrame:
    """The label of one document; the filter reaches the scan."""
    return labels.where(F.col("pdf_hash") == pdf_hash)


def labels_newest_first(labels: DataFrame) -> DataFrame:
    return labels.orderBy(F.col("updated_at").desc(), F.col("pdf_hash"))


def latest_label(events: DataFrame) -> DataFrame:
    """Last event per hash, by time and event id, combined before the shuffle."""
    rest = [c for c in events.columns if c != "pdf_hash"]
    last = F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_last")
    return events.groupBy("pdf_hash").agg(last).select("pdf_hash", *[F.col(f"_last.{c}").alias(c) for c in rest])


def label_upsert(labels: DataFrame, changes: DataFrame, now: str | None = None) -> DataFrame:
    """Labels after saving ``changes`` (at most the last per hash counts; see :func:`latest_label`).

    A saved label takes the new path, corners and update time; its creation time survives.
    ``changes`` has the label columns and ``ts``; ``now`` overrides the time of the save.
    """
    saved_at = F.lit(now).cast("timestamp_ntz") if now else F.col("_new.ts")
    new = changes.select("pdf_hash", F.struct("ts", *LABEL_PAYLOAD).alias("_new"))
    old = labels.select("pdf_hash", F.struct("created_at", "updated_at", *LABEL_PAYLOAD).alias("_old"))
    merged = old.join(new, "pdf_hash", "full")
    saved = F.col("_new").isNotNull()
    payload = [F.when(saved, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in LABEL_PAYLOAD]
    return merged.select(
        "pdf_hash",
        *payload,
        F.when(F.col("_old").isNotNull(), F.col("_old.created_at")).otherwise(saved_at).alias("created_at"),
        F.when(saved, saved_at).otherwise(F.col("_old.updated_at")).alias("updated_at"),
    )


def label_delete(labels: DataFrame, keys: DataFrame) -> DataFrame:
    return labels.join(keys.select("pdf_hash"), "pdf_hash", "left_anti")


def label_status(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Catalog rows with a flag: has the document a label?"""
    labelled = labels.select(F.col("pdf_hash").alias("hash"), F.lit(True).alias("_labelled")).distinct()
    joined = salted_join(documents, labelled, ["hash"], salt_by=["path"], how="left")
    return joined.withColumn("is_labeled", F.coalesce("_labelled", F.lit(False))).drop("_labelled")


def unlabeled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The work queue: documents without a label."""
    return missing_from(documents, labels.select(F.col("pdf_hash").alias("hash")), "hash")


def label_progress(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, all labels (orphans included), and labelled documents, as one row."""
    zero = F.lit(0).cast("bigint")
    in_catalog = label_status(documents, labels).agg(
        F.count("*").alias("total"), F.count_if("is_labeled").alias("labeled_in_catalog")
    )
    everything = labels.agg(F.count("*").alias("labeled_total"))
    parts = in_catalog.withColumn("labeled_total", zero).unionByName(
        everything.select(zero.alias("total"), zero.alias("labeled_in_catalog"), "labeled_total")
    )
    return parts.agg(*[F.sum(c).alias(c) for c in ("total", "labeled_total", "labeled_in_catalog")])


def coverage_by_place(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labelled documents per city, per state and overall.

    Cities are counted first; the rollup then expands one row per city, not one per document.
    """
    per_city = label_status(documents, labels).groupBy("state", "city").agg(
        F.count("*").alias("documents"), F.count_if("is_labeled").alias("labeled")
    )
    return per_city.rollup("state", "city").agg(
        F.sum("documents").alias("documents"), F.sum("labeled").alias("labeled"), F.grouping_id().alias("level")
    )


def labels_nested(labels: DataFrame) -> DataFrame:
    """The exchange form: nested corners and ISO timestamps."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return labels.select(
        "pdf_hash", "pdf_path", corners_nest().alias("corners"),
        iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"),
    )


def labels_flat(nested: DataFrame) -> DataFrame:
    return nested.select("pdf_hash", "pdf_path", *corners_flatten(F.col("corners")))


def labels_as_map(labels: DataFrame, digits: int = 4) -> DataFrame:
    """Lookup maps hash -> label, one per hash prefix.

    One map of all labels would have to fit one task. Hashes are unique and even, so a prefix of ``digits``
    hexadecimal digits makes 16^digits maps of about equal size, the same keys whatever the table holds.
    """
    prefixed = labels_nested(labels).withColumn("prefix", F.substring("pdf_hash", 1, digits))
    entry = F.struct("pdf_hash", F.struct("pdf_path", "corners", "created_at", "updated_at"))
    return prefixed.groupBy("prefix").agg(F.map_from_entries(F.collect_list(entry)).alias("labels"))


def round_corners(labels: DataFrame) -> DataFrame:
    return labels.withColumns({c: round_corner(F.col(c)) for c in CORNER_COLUMNS})


def with_centroid(labels: DataFrame) -> DataFrame:
    center = corners_centroid(corners_nest())
    return labels.withColumns({"center_lng": center.lng, "center_lat": center.lat})


def corners_bbox(labels: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Bounding box of every label, or of all labels per ``by`` group (an empty list: of all)."""
    lngs = [F.col(c) for c in CORNER_COLUMNS if c.endswith("_lng")]
    lats = [F.col(c) for c in CORNER_COLUMNS if c.endswith("_lat")]
    boxed = labels.withColumns({
        "west": F.least(*lngs), "south": F.least(*lats), "east": F.greatest(*lngs), "north": F.greatest(*lats),
    })
    if by is None:
        return boxed.select("pdf_hash", "west", "south", "east", "north")
    return boxed.groupBy(*by).agg(
        F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"),
    )


# --- bulk corrections: labels joined with a table of adjustments by hash ---------------------------


def _moved(labels: DataFrame, adjustments: DataFrame, move) -> DataFrame:
    """Labels with corners replaced by ``move(axis, lng, lat)``; labels without adjustment stay.

    A label adjusted twice would have two places, so a repeated hash among the adjustments is an error.
    """
    counted = adjustments.groupBy("pdf_hash").agg(F.count("*").alias("_times"), *[F.first(c).alias(c) for c in adjustments.columns if c != "pdf_hash"])
    twice = F.raise_error(F.concat(F.lit("more than one adjustment of label "), F.col("pdf_hash")))
    single = counted.where(F.when(F.col("_times") > 1, twice.cast("boolean")).otherwise(F.lit(True))).drop("_times")
    joined = labels.join(single, "pdf_hash", "left")
    changed = {}
    for corner in ("top_left", "top_right", "bottom_right", "bottom_left"):
        lng, lat = F.col(f"{corner}_lng"), F.col(f"{corner}_lat")
        for axis, old in (("lng", lng), ("lat", lat)):
            changed[f"{corner}_{axis}"] = F.coalesce(move(axis, lng, lat), old)
    return joined.withColumns(changed).select(*labels.columns)


def translate_corners(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """Shift all corners by ``dx, dy`` of the label's move."""
    shift = {"lng": "dx", "lat": "dy"}
    return _moved(labels, moves, lambda axis, lng, lat: (lng if axis == "lng" else lat) + F.col(shift[axis]))


#: The corner that stays fixed while another one is dragged.
OPPOSITE = {
    "top_left": "bottom_right",
    "top_right": "bottom_left",
    "bottom_right": "top_left",
    "bottom_left": "top_right",
}


def scale_corners(labels: DataFrame, scales: DataFrame) -> DataFrame:
    """Scale about the corner opposite to the dragged one.

    ``scales`` has ``handle`` (the dragged corner) and its new position ``to_lng, to_lat``. The factor
    is the ratio of the distances to the fixed corner; a label without extent stays as it is.
    """

    def pick(side: str, axis: str):
        chosen = F.lit(None).cast("double")
        for handle, fixed in OPPOSITE.items():
            source = handle if side == "dragged" else fixed
            chosen = F.when(F.col("handle") == handle, F.col(f"{source}_{axis}")).otherwise(chosen)
        return chosen

    ax, ay = pick("fixed", "lng"), pick("fixed", "lat")
    reach = lambda x, y: F.sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))
    factor = F.try_divide(reach(F.col("to_lng"), F.col("to_lat")), reach(pick("dragged", "lng"), pick("dragged", "lat")))

    def move(axis, lng, lat):
        about, value = (ax, lng) if axis == "lng" else (ay, lat)
        return about + (value - about) * factor

    return _moved(labels, scales, move)


def rotate_corners(labels: DataFrame, angles: DataFrame) -> DataFrame:
    """Rotate about the centroid by ``angle`` (radians)."""
    center = corners_centroid(corners_nest())
    cos, sin = F.cos("angle"), F.sin("angle")

    def move(axis, lng, lat):
        dx, dy = lng - center.lng, lat - center.lat
        return center.lng + dx * cos - dy * sin if axis == "lng" else center.lat + dx * sin + dy * cos

    return _moved(labels, angles, move)


def pixel_to_geo(points: DataFrame, labels: DataFrame, width: float, height: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Locate points of a map sheet (``pdf_hash, px, py``) on the ground through the sheet's corners."""
    nested = labels.select("pdf_hash", corners_nest().alias("_corners"))
    at = bilinear(F.col("_corners"), F.col("px") / float(width), F.col("py") / float(height))
    located = salted_join(points, nested, ["pdf_hash"], salt_by=points.columns, hot_rows=hot_rows).withColumn("_at", at)
    return located.select(*points.columns, F.col("_at.lng").alias("lng"), F.col("_at.lat").alias("lat"))

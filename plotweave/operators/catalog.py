"""The document catalog: a manifest of content hashes and paths, and lookups in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import paths
from plotweave.functions.text import blank_to_null, norm_text, strip
from plotweave.plans.picking import priority_pick
from plotweave.plans.skew import HOT_ROWS, missing_from, salted_join


def pdf_catalog_filter(manifest: DataFrame) -> DataFrame:
    """Entries that are maps in PDF form; both tests are case-sensitive."""
    path = F.col("relpath")
    return manifest.where(F.startswith(path, F.lit(paths.MAPS_PREFIX)) & F.endswith(path, F.lit(".pdf")))


def extension_guard(requests: DataFrame, allowed: Sequence[str], column: str = "path") -> tuple[DataFrame, DataFrame]:
    """Requests with an accepted extension, and the rejected rest."""
    accepted = F.lit(False)
    for extension in allowed:
        accepted = accepted | F.endswith(F.col(column), F.lit(extension))
    accepted = F.coalesce(accepted, F.lit(False))
    return requests.where(accepted), requests.where(~accepted)


def catalog_fields(manifest: DataFrame) -> DataFrame:
    """Path below ``maps/``, file name, state and city of each entry."""
    rel = F.col("relpath")
    derived = {
        "path": F.regexp_replace(rel, "^maps/", ""),
        "name": paths.last_segment(rel),
        "state": paths.segment(rel, 1),
        "city": paths.segment(rel, 2),
    }
    return manifest.withColumnRenamed("md5", "hash").withColumns(derived)


def catalog(manifest: DataFrame) -> DataFrame:
    """The catalog of map documents: filter, then derived fields."""
    return catalog_fields(pdf_catalog_filter(manifest))


def catalog_search(documents: DataFrame, query: str) -> DataFrame:
    """Type-ahead: documents whose state/city/name label contains the trimmed query, case ignored."""
    label = paths.display_label(F.col("state"), F.col("city"), F.col("name"))
    return documents.withColumn("label", label).where(F.contains(F.lower("label"), F.lower(strip(F.lit(query)))))


def first_by(df: DataFrame, key: str, order: str, *payload: str) -> DataFrame:
    """One row per key: the payload of the lowest order value, combined before the shuffle."""
    first = F.min_by(F.struct(*payload), F.col(order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in payload])


def hash_by_path(requests: DataFrame, manifest: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hash of every requested map path, from the first manifest entry with that path; null if unknown.

    ``requests`` has ``path`` and whatever tells requests for the same path apart.
    """
    wanted = requests.withColumn("relpath", F.concat(F.lit(paths.MAPS_PREFIX), F.col("path")))
    known = first_by(manifest, "relpath", "ord", "md5")
    return salted_join(wanted, known, ["relpath"], salt_by=requests.columns, hot_rows=hot_rows, how="left")


def candidate_paths(path: Column) -> Column:
    """Places a GeoJSON path may live at: as given, then with a geojson folder below the city."""
    parts = F.split(path, "/")
    inner = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    prefix = F.lit(paths.MAPS_PREFIX)
    return F.array(
        F.concat(prefix, path),
        F.concat(prefix, paths.segment(path, 0), F.lit("/"), paths.segment(path, 1), F.lit("/geojson/"), inner),
    )


def resolve_candidates(requests: DataFrame, manifest: DataFrame, candidates: Column) -> DataFrame:
    """First existing candidate of every request (``request_id``); its hash is null when none exists."""
    tried = requests.select("*", F.posexplode(candidates).alias("_pos", "relpath"))
    known = first_by(manifest, "relpath", "ord", "md5")
    found = salted_join(tried, known, ["relpath"], salt_by=["request_id"], how="left")
    # Misses sort last, so a request without any match keeps one row with a null hash.
    best = priority_pick(found, ["request_id"], [F.col("md5").isNull(), F.col("_pos")])
    return best.withColumn("relpath", F.when(F.col("md5").isNotNull(), F.col("relpath"))).drop("_pos")


def document_by_hash(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Catalog row of every requested hash; of equal contents the first entry, null if unknown."""
    known = first_by(documents, "hash", "ord", "path", "name", "state", "city")
    return salted_join(requests, known, ["hash"], salt_by=requests.columns, how="left")


def pending_downloads(targets: DataFrame, inventory: DataFrame, on: str = "relpath") -> DataFrame:
    """Targets that are not in the inventory yet."""
    return missing_from(targets, inventory, on)


def new_files(now: DataFrame, before: DataFrame, on: str = "path") -> DataFrame:
    """Files of the current listing that an earlier listing does not have."""
    return missing_from(now, before, on)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What happened to each path: added, removed, modified, moved or unchanged.

    An added path whose content was removed elsewhere counts as moved, and names the path it left.
    """
    entries = old.select("relpath", "md5", F.col("ord").alias("_old")).unionByName(
        new.select("relpath", "md5", F.col("ord").alias("_new")), allowMissingColumns=True
    )
    # One aggregation instead of a join of two: rows without an order on one side do not count there.
    both = entries.groupBy("relpath").agg(F.min_by("md5", "_old").alias("old_md5"), F.min_by("md5", "_new").alias("new_md5"))
    # Only added paths look for the place they came from; the bulk is never shuffled by content. Removed
    # paths are folded to one row per content first, so copies of a file do not multiply the result.
    gone = both.where("new_md5 IS NULL").groupBy(F.col("old_md5").alias("new_md5")).agg(F.min("relpath").alias("moved_from"))
    added = salted_join(both.where("old_md5 IS NULL"), gone, ["new_md5"], salt_by=["relpath"], how="left")
    origin = F.when(F.col("moved_from").isNotNull(), "moved").otherwise("added")
    kept = both.where("old_md5 IS NOT NULL")
    fate = (
        F.when(F.col("new_md5").isNull(), "removed")
        .when(F.col("old_md5") != F.col("new_md5"), "modified")
        .otherwise("unchanged")
    )
    columns = ["relpath", "old_md5", "new_md5", "status", "moved_from"]
    nowhere = F.lit(None).cast("string")
    return added.withColumn("status", origin).select(columns).unionByName(
        kept.withColumns({"status": fate, "moved_from": nowhere}).select(columns)
    )


def dir_listing(files: DataFrame, prefix: str, path: str = "relpath") -> DataFrame:
    """Immediate sub-folders of a prefix; entries that stand for the folder itself are skipped."""
    below = F.substr(F.col(path), F.lit(len(prefix) + 1))
    return (
        files.where(F.startswith(F.col(path), F.lit(prefix)))
        .where(F.contains(below, F.lit("/")))
        .select(F.split(below, "/", 2)[0].alias("dir"))
        .where(F.col("dir") != "")
        .distinct()
    )


def manifest_version(lines: DataFrame, override: str | None = None) -> DataFrame:
    """Snapshot id of a pin file: the override if given, else the first ``md5: <id>.dir`` line.

    ``lines`` has ``file, line_no, value``; one row per file comes out.
    """
    pinned = blank_to_null(F.regexp_extract("value", r"md5: ([0-9a-f]+)(?:\.dir)?", 1))
    matching = lines.where(F.contains("value", F.lit("md5:"))).withColumn("pinned", pinned)
    first = first_by(matching, "file", "line_no", "pinned")
    return first.select("file", F.coalesce(F.lit(override or None), F.col("pinned")).alias("manifest_id"))


def display_labels(documents: DataFrame) -> DataFrame:
    """Catalog rows with the label a picker shows."""
    return documents.withColumn("label", paths.display_label(F.col("state"), F.col("city"), F.col("name")))


def object_by_hash(requests: DataFrame, objects: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Length and time of the stored object of every requested ``hash``; null if nothing is stored under its key.

    ``objects`` is a listing with ``object_key`` (:func:`plotweave.functions.paths.content_addressed_layout`), ``length`` and ``modificationTime``.
    """
    keyed = requests.withColumn("object_key", paths.content_addressed_layout(F.col("hash")))
    stored = objects.groupBy("object_key").agg(F.max(F.struct("modificationTime", "length")).alias("_o")).select(
        "object_key", "_o.length", "_o.modificationTime")
    return salted_join(keyed, stored, ["object_key"], salt_by=requests.columns, hot_rows=hot_rows, how="left")


def corpus_size(files: DataFrame, name: Column | None = None) -> DataFrame:
    """Bytes and number of files; with ``name``, files of one name are parts of one file."""
    whole = files if name is None else files.groupBy(name.alias("_name")).agg(F.sum("length").alias("length"))
    return whole.agg(
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"), F.count("*").alias("n_files")
    )


def url_grid(directions: DataFrame, lo: int, hi: int, template: str, column: str = "direction") -> DataFrame:
    """Candidate URLs of a numbered sheet grid: every direction with every number, three digits."""
    numbered = directions.withColumn("number", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return numbered.withColumn("url", F.format_string(template, F.col(column), F.col("number")))


def http_ok(probes: DataFrame) -> DataFrame:
    return probes.where(F.col("status") == 200)


def distinct_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.select(column).distinct()


def order_by_name(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending by code point."""
    return df.orderBy(*columns)


def state_dim(states: DataFrame, base_url: str) -> DataFrame:
    """State dimension (``abbrev, name``) with its URL, and the federal district added."""
    district = states.sparkSession.range(1).select(F.lit("dc").alias("abbrev"), F.lit("District of Columbia").alias("name"))
    both = states.select(F.lower("abbrev").alias("abbrev"), "name").unionByName(district)
    return both.withColumn("url", F.concat(F.lit(base_url + "/"), F.col("abbrev")))


def state_name_lookup(df: DataFrame, states: DataFrame, column: str = "abbrev") -> DataFrame:
    """Full state name, or the input itself when it is no state."""
    names = states.select(F.lower("abbrev").alias("_key"), F.col("name").alias("_name"))
    joined = df.join(names, F.lower(F.col(column)) == F.col("_key"), "left")
    return joined.withColumn("state_name", F.coalesce(F.col("_name"), F.col(column))).drop("_key", "_name")


def gazetteer_lookup(queries: DataFrame, gazetteer: DataFrame, country: str = "us", n: int = 5) -> DataFrame:
    """Up to ``n`` places per query (``query_id, query``), null place when there is none; blank queries vanish.

    Ranking depends on the gazetteer only, so it is cut to ``n`` places per name before the join:
    a name with countless places cannot blow up the result.
    """
    places = (
        gazetteer.where(F.col("country") == country)
        .withColumn("_name", norm_text(F.col("name")))
    )
    top = priority_pick(places, ["_name"], [F.col("place_rank"), F.col("place_id")], n)
    asked = queries.withColumn("_name", norm_text(F.col("query"))).where(F.col("_name") != "")
    return salted_join(asked, top.drop("country"), ["_name"], salt_by=["query_id"], how="left").drop("_name")


def parse_coordinates(places: DataFrame) -> DataFrame:
    """Text coordinates and bounding box as doubles; unreadable text becomes null."""
    number = lambda c: c.try_cast("double")
    return places.withColumns({
        "lat": number(F.col("lat")),
        "lon": number(F.col("lon")),
        "bbox": F.transform("bbox", number),
    })

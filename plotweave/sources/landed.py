"""Readers of landed data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave import schemas
from plotweave.functions.text import blank_to_null
from plotweave.plans.once import with_once


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    """A manifest: one file with a JSON array, or a folder of numbered shards of one.

    ``ord`` is the place in the manifest, which decides what "first match" means: files in the order of their
    paths, numbers in them taken as numbers (part 10 after part 2), then entries of a file.
    Every shard is parsed whole, in any layout, by one task; :func:`manifest_split_scan` reads one shard with many.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json("value", schemas.MANIFEST_ARRAY, {"mode": "FAILFAST"}).alias("entries"),
    )
    entries = files.join(_shards(spark, path), "file").select("shard", F.posexplode("entries").alias("pos", "entry"))
    place = F.shiftleft(F.col("shard"), 32) + F.col("pos")
    return entries.select("entry.md5", "entry.relpath", place.alias("ord"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """``file, shard``: files numbered in the order of their paths, one row per file."""
    # Numbers padded to twenty digits sort as numbers do. One row per file, so ranking them is little work.
    padded = F.array_join(F.transform(
        F.regexp_extract_all("file", F.lit(r"\d+|\D+"), F.lit(0)),
        lambda part: F.when(F.rlike(part, F.lit(r"^\d")), F.lpad(part, 20, "0")).otherwise(part)), "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))
    return files.select("file", (F.row_number().over(Window.orderBy(padded, "file")) - 1).cast("bigint").alias("shard"))


def ordered_pieces(spark: SparkSession, path: str, border: str) -> DataFrame:
    """Files cut at a border that tasks find by themselves: ``source, number, value``, pieces numbered from 0 in each file.

    A file is read in blocks, each by one task and in order. One pass counts the pieces of each block; the sums over the blocks before, one
    small row per block, give the numbers. Both passes cut the files into the same blocks and rows; if a file changes in between and
    a piece falls outside the counted range, the read fails.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", border).option("recursiveFileLookup", True).text(path).select(
        meta.file_path.alias("source"), meta.file_block_start.alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = pieces.groupBy("source", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counted = blocks.select("source", "_block", "_n", "_from", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.col("_from")
    moved = F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("source"))).cast("bigint")
    number = F.col("_before") + F.when((inside >= 0) & (inside < F.col("_n")), inside).otherwise(moved)
    return pieces.join(counted, ["source", "_block"], "left").select("source", number.alias("number"), "value")


def manifest_split_scan(spark: SparkSession, path: str) -> DataFrame:
    """:func:`manifest_scan` of shards too large for one task: the same ``md5, relpath, ord``.

    Files are cut at the name of an entry's first member, md5, so that many tasks read one file and each parses single entries, compact,
    spaced or indented. An entry of another order, without a path or cut short fails the read, and so does a file without entries that is no
    empty array; such manifests are read whole.
    """
    key = '"md5"'
    pieces = ordered_pieces(spark, path, key)
    head = F.col("number") == 0
    opened = F.rlike("value", F.lit(r"^\s*\[\s*\{\s*$")) | F.rlike("value", F.lit(r"^\s*\[\s*\]\s*$"))
    entry = F.concat(F.lit("{" + key), "value")
    rest = F.rlike("value", F.lit(r"(,\s*\{|\])\s*$"))
    parsed = with_once(pieces.where(~head | ~opened).withColumn("_entry", entry), "e", F.from_json(
        "_entry", "md5 STRING, relpath STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    members = F.json_object_keys("_entry")
    whole = ~head & rest & F.col("e._bad").isNull() & F.array_contains(members, "md5") & F.array_contains(members, "relpath")
    failed = F.raise_error(F.concat(F.lit("not an entry with its md5 first in "), F.col("source"), F.lit(": "), F.substring("value", 1, 80)))
    checked = parsed.where(F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(failed.cast("boolean")))
    placed = checked.join(_shards(spark, path), checked["source"] == F.col("file"))
    return placed.select("e.md5", "e.relpath", (F.shiftleft(F.col("shard"), 32) + F.col("number") - 1).alias("ord"))


def geojson_scan(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One row per feature of stored collections: ``source, pos, type, geometry, properties``.

    Collections are one per line by default, which splits; ``multiline`` reads one per file, in any layout. What
    is no collection fails the read; :func:`collection_rejects` lists such texts instead.
    """
    return collection_features(collection_texts(spark, path, multiline))


def collection_texts(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``source, value``: the texts :func:`geojson_scan` parses; blank ones are no texts."""
    texts = spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("source"), "value")
    return texts.where(F.trim("value") != "")


def geojson_split_scan(spark: SparkSession, path: str) -> DataFrame:
    """Features of collections too large for one task: ``source, pos, geometry, properties``.

    Files are cut at the word that names a feature's type, so that many tasks read one file and each parses single
    features, compact, spaced or indented. That needs the type to be the first member of a feature, as writers put
    it. A piece without geometry or properties, cut short or in another order fails the read; such files
    are read whole (:func:`geojson_scan`). ``pos`` is the place in the file.
    """
    kind = '"Feature"'
    pieces = ordered_pieces(spark, path, kind)
    # What precedes the first feature is the head of the collection. What follows a feature up to the next
    # one (a comma, or the end of the collection) is behind the closed object, where the parser stops.
    head = F.startswith(F.ltrim("value"), F.lit("{"))
    nothing = F.rlike("value", F.lit(r'"features"\s*:\s*\[\s*\]'))
    cut = pieces.where(~head | ~F.rlike("value", F.lit(r'\{\s*"type"\s*:\s*$')) & ~nothing)
    piece = F.when(head, F.col("value")).otherwise(F.concat(F.lit('{"type":' + kind), "value"))
    parsed = with_once(cut.select("source", "number", piece.alias("piece")), "f", F.from_json(
        "piece", "type STRING, geometry STRING, properties STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    members = F.json_object_keys("piece")
    whole = (F.col("f.type") == "Feature") & F.col("f._bad").isNull() & F.array_contains(members, "geometry") & F.array_contains(members, "properties")
    failed = F.raise_error(F.concat(F.lit("not a feature with its type first in "), F.col("source"), F.lit(": "), F.substring("piece", 1, 80)))
    checked = parsed.where(F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(failed.cast("boolean")))
    return with_once(checked, "g", F.from_json("piece", schemas.FEATURE)).select(
        "source", (F.col("number") - 1).alias("pos"), "g.geometry", "g.properties")


def _parsed_collections(texts: DataFrame) -> DataFrame:
    """Texts with ``doc`` and ``reason``, null for a collection."""
    schema = f"{schemas.FEATURE_COLLECTION}, _bad STRING"
    parsed = with_once(texts, "doc", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.trim("value") == "", "blank").when(F.col("doc").isNull() | F.col("doc._bad").isNotNull(), "no JSON").when(
        F.col("doc.error").isNotNull(), F.concat(F.lit("service error: "), F.col("doc.error"))).when(F.col("doc.features").isNull(), "no features")
    return parsed.withColumn("reason", reason)


def collection_features(texts: DataFrame) -> DataFrame:
    """Features of collections; a text that is none fails the read."""
    failed = F.raise_error(F.concat(F.lit("not a collection in "), F.col("source"), F.lit(": "), F.col("reason")))
    checked = _parsed_collections(texts).withColumn("features", F.when(F.col("reason").isNull(), F.col("doc.features")).otherwise(failed))
    return checked.select("source", F.posexplode("features").alias("pos", "f")).select("source", "pos", "f.geometry", "f.properties")


def collection_rejects(texts: DataFrame) -> DataFrame:
    """``source, reason, value`` of the texts that are no collection."""
    return _parsed_collections(texts).where("reason IS NOT NULL").select("source", "reason", "value")


def feature_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited features, the form the sink writes. A line that is no feature fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = with_once(lines, "f", F.from_json("value", schemas.FEATURE))
    failed = F.raise_error(F.concat(F.lit("no feature: "), F.substring("value", 1, 80)))
    return parsed.where(F.when(F.col("f.type") == "Feature", F.lit(True)).otherwise(failed.cast("boolean"))).select("f.geometry", "f.properties")


def _judged_pages(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(schemas.LANDED_PAGE).json(path).withColumn("value", F.coalesce("body", F.lit("")))
    status = F.when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status")))
    return _parsed_collections(pages).withColumn("reason", F.coalesce(status, F.col("reason")))


def geojson_page_scan(spark: SparkSession, path: str) -> DataFrame:
    """Features of landed GeoJSON pages (one response per line). A page with an error status, a service error or an
    unreadable body fails the read; :func:`geojson_page_rejects` lists such pages instead."""
    failed = F.raise_error(F.concat_ws(" ", F.lit("page of layer"), "layer_id", F.lit("is unusable:"), "reason"))
    checked = _judged_pages(spark, path).withColumn("features", F.when(F.col("reason").isNull(), F.col("doc.features")).otherwise(failed))
    return checked.select("layer_id", "page_no", F.posexplode("features").alias("pos", "f")).select(
        "layer_id", "page_no", "pos", "f.geometry", "f.properties"
    )


def geojson_page_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``layer_id, page_no, status, reason`` of landed pages without usable features."""
    return _judged_pages(spark, path).where("reason IS NOT NULL").select("layer_id", "page_no", "status", "reason")


def page_crs(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate system of each layer as its last page names it; null when that page has none."""
    pages = spark.read.schema(schemas.LANDED_PAGE).json(path)
    crs = F.get_json_object("body", "$.crs")
    return pages.groupBy("layer_id").agg(F.max_by(crs, "page_no").alias("crs"))


def feature_page_scan(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses of a feature service: envelope columns and the untouched body."""
    return spark.read.schema(schemas.LANDED_PAGE).json(path)


def item_info_scan(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service URL of landed item documents (``item_id, body``), and the items that have none."""
    url = blank_to_null(F.get_json_object("body", "$.url"))
    read = items.select("item_id", url.alias("service_url"))
    return read.where("service_url IS NOT NULL"), read.where("service_url IS NULL").drop("service_url")


def html_scan(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: ``page_id, url, html``."""
    return spark.read.schema("page_id BIGINT, url STRING, html STRING").parquet(path)


def url_list_scan(spark: SparkSession, path: str) -> DataFrame:
    """A list file of URLs, one per line: distinct, blank lines and comments left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).distinct()


def pin_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of pin files (small text files) with file and line number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def labels_scan(spark: SparkSession, path: str, pdf_hash: str | None = None) -> DataFrame:
    """The label table, or one label of it (the hash is pushed to the scan)."""
    labels = spark.read.parquet(path)
    return labels if pdf_hash is None else labels.where(F.col("pdf_hash") == pdf_hash)


def webmap_layer_scan(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Web map documents, one per line or one per file."""
    return spark.read.schema(schemas.WEBMAP).option("multiLine", multiline).json(path)


def binary_doc_scan(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files with content. Select only what is needed: an unselected content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(root)
    )


def object_metadata(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, length and time of files, without their bytes."""
    return binary_doc_scan(spark, root, glob).select("path", "length", "modificationTime")


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme the listing puts in front."""
    return F.substring_index(path, root.rstrip("/") + "/", -1)

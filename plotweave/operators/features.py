"""Map features: paging, conversion, union, filters and export forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.rings import nested_rings
from plotweave.functions.text import strip
from plotweave.plans.once import with_once
from plotweave.plans.ordered import number_segment, ordered_row_number, ordered_slice
from plotweave.schemas import SERVICE_PAGE_BODY

SOURCE_LAYER = "_source_layer"
DEFAULT_PAGE = 1000
#: Requests planned at a time from one layer row.
PLAN_BLOCK = 10_000


# --- planning requests -----------------------------------------------------------------------------


def layer_catalog(services: DataFrame, layer_info: DataFrame) -> DataFrame:
    """Layers of every service with their paging abilities; a service without layers is an error."""
    checked = services.withColumn(
        "layers",
        F.when(F.coalesce(F.size("layers"), F.lit(0)) > 0, F.col("layers")).otherwise(
            F.raise_error(F.concat(F.lit("no layers in service "), F.col("service")))
        ),
    )
    layers = checked.select("service", F.inline("layers"))
    return layer_info_join(layers, layer_info)


def layer_info_join(layers: DataFrame, info: DataFrame) -> DataFrame:
    """Paging abilities per layer; what a layer does not say defaults to no paging, 1000 rows."""
    joined = layers.join(info, ["service", "id"], "left")
    return joined.select(
        "service", F.col("id").alias("layer_id"), F.col("name").alias("layer_name"),
        F.coalesce("supportsPagination", F.lit(False)).alias("supports_pagination"),
        F.coalesce("maxRecordCount", F.lit(DEFAULT_PAGE)).alias("max_record_count"),
    )


def page_plan(layers: DataFrame, total: Column, page_size: Column) -> DataFrame:
    """One row per request: offsets 0, n, 2n ... below the total; empty layers need none."""
    pages = F.ceil(total / page_size).cast("bigint")
    block = F.lit(PLAN_BLOCK).cast("bigint")

    def counted(first: Column, last: Column, step: Column) -> Column:
        return F.when(last >= first, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))

    # Two steps, so that no row ever holds the offsets of a whole huge layer.
    blocks = layers.select("*", pages.alias("_pages"), page_size.cast("bigint").alias("_size")).withColumn(
        "_block", F.explode(counted(F.lit(0).cast("bigint"), F.col("_pages") - 1, block))
    )
    last = F.least(F.col("_block") + block, F.col("_pages")) - 1
    planned = blocks.withColumn("page_no", F.explode(counted(F.col("_block"), last, F.lit(1).cast("bigint"))))
    return planned.withColumn("result_offset", F.col("page_no") * F.col("_size")).drop("_pages", "_size", "_block")


def id_chunk_plan(ids: DataFrame, layer: str, id_column: str, size: int) -> DataFrame:
    """Ids of every layer in chunks of ``size``, in id order, comma-joined.

    Chunks need the row number within the layer; it is computed without gathering a layer in one task.
    """
    numbered = ordered_row_number(ids.select(layer, id_column), [id_column], number_segment(id_column), [layer])
    chunked = numbered.withColumn("chunk_no", F.floor((F.col("row_no") - 1) / F.lit(size)).cast("bigint"))
    in_chunk = F.array_sort(F.collect_list(id_column))
    return chunked.groupBy(layer, "chunk_no").agg(
        F.array_join(F.transform(in_chunk, lambda i: i.cast("string")), ",").alias("object_ids"),
        F.count("*").alias("n_ids"),
    )


def page_slice(df: DataFrame, order: Sequence[str | Column], segment: Column, offset: int, n: int) -> DataFrame:
    """Rows ``offset .. offset + n`` in a total order; ``segment`` never falls along it (:mod:`plotweave.plans.ordered`)."""
    return ordered_slice(df, order, segment, offset, n)


# --- landed pages ----------------------------------------------------------------------------------


def parse_pages(pages: DataFrame) -> DataFrame:
    """Landed pages with the parsed body; unreadable bodies parse to nulls, the page stays."""
    return with_once(pages, "parsed", F.from_json("body", SERVICE_PAGE_BODY, {"mode": "PERMISSIVE"}))


def answered() -> Column:
    """The request succeeded and its answer has text."""
    return (F.coalesce(F.trim("body"), F.lit("")) != "") & (F.coalesce("status", F.lit(200)) < 400)


def readable() -> Column:
    """The body parsed to features, and to no error object."""
    return F.col("parsed.features").isNotNull() & F.col("parsed.error").isNull()


def empty_response_check(pages: DataFrame) -> DataFrame:
    """Per page: is there an answer with text? Pages that fail are skipped, the rest is kept."""
    return pages.select(page_key(), F.lit("has_response").alias("rule"), answered().alias("passed"))


def service_error_check(pages: DataFrame) -> DataFrame:
    """Per page: did the service answer with an error object?"""
    failed = F.get_json_object("body", "$.error").isNotNull()
    return pages.select(page_key(), F.lit("no_service_error").alias("rule"), (~failed).alias("passed"))


def page_key() -> Column:
    return F.concat_ws("/", "layer_id", "page_no").alias("key")


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with a readable body and no error object."""
    parsed = parse_pages(pages.where(answered()))
    return parsed.where(readable())


def layer_isolation(pages: DataFrame) -> DataFrame:
    """Per layer: pages that gave rows and pages that failed. A failing layer does not stop others."""
    good = F.coalesce(answered() & readable(), F.lit(False))
    marked = parse_pages(pages).select("layer_id", "layer_name", good.alias("good"))
    counted = marked.groupBy("layer_id", "layer_name").agg(
        F.count_if("good").alias("good_pages"), F.count_if(~F.col("good")).alias("failed_pages")
    )
    return counted.select(
        F.col("layer_id").cast("string").alias("key"), F.lit("layer_complete").alias("rule"),
        (F.col("failed_pages") == 0).alias("passed"), "good_pages", "failed_pages",
    )


def page_features(pages: DataFrame) -> DataFrame:
    """One row per feature of the usable pages, with its place in the page."""
    return usable_pages(pages).select(
        "layer_id", "layer_name", "page_no", F.posexplode("parsed.features").alias("pos", "feature")
    ).select("layer_id", "layer_name", "page_no", "pos", "feature.attributes", "feature.geometry")


def geometry_kind(geometry: Column) -> Column:
    """GeoJSON type of a service geometry; null when it is empty or of another kind."""
    return (
        F.when(geometry.rings.isNotNull(), "Polygon")
        .when(geometry.paths.isNotNull(), "LineString")
        .when(geometry.x.isNotNull() & geometry.y.isNotNull(), "Point")
    )


def has_geometry(features: DataFrame) -> DataFrame:
    return features.where(F.col("geometry").isNotNull() & geometry_kind(F.col("geometry")).isNotNull())


def tag_source_layer(attributes: Column, layer: Column) -> Column:
    """Attributes plus the layer they come from; an attribute of that name gives way."""
    others = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,variant>")), lambda k, _: k != SOURCE_LAYER)
    return F.map_concat(others, F.create_map(F.lit(SOURCE_LAYER), layer.cast("variant")))


def esri_to_geojson(features: DataFrame, multipart: bool = False, nest: bool = False) -> DataFrame:
    """Service features as stored features: geometry as type and coordinate text, tagged attributes.

    Of a line only the first path is kept and all rings form one polygon; ``multipart`` gives every
    path a row of its own instead. With ``nest`` rings are sorted by which lies in which: every ring at an even depth becomes a polygon with the rings
    right inside it as holes, and several polygons a MultiPolygon, in the order of their shells. Without a ring that has
    vertices the rings stay as they are.
    """
    kept = has_geometry(features)
    geometry = F.col("geometry")
    if multipart:
        paths = F.explode_outer(geometry.paths)
        kept = kept.withColumn("_path", paths)
    else:
        kept = kept.withColumn("_path", F.try_element_at(geometry.paths, F.lit(1)))
    kind, area = geometry_kind(geometry), F.to_json(geometry.rings)
    if nest:
        corners = F.transform(geometry.rings, lambda r: F.transform(r, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))))
        several = F.size(geometry.rings) > 1
        kept = kept.withColumn("_groups", nested_rings(F.when(several, corners).otherwise(F.slice(corners, 1, 0))))
        polygons = F.transform("_groups", lambda g: F.transform(g, lambda i: F.get(geometry.rings, i)))
        kind = F.when(several & (F.size("_groups") > 1), "MultiPolygon").otherwise(kind)
        area = F.when(several & (F.size("_groups") > 1), F.to_json(polygons)).when(several & (F.size("_groups") == 1), F.to_json(F.get(polygons, F.lit(0)))).otherwise(area)
    coordinates = (
        F.when(geometry.rings.isNotNull(), area)
        .when(geometry.paths.isNotNull(), F.to_json(F.col("_path")))
        .otherwise(F.to_json(F.array(geometry.x, geometry.y)))
    )
    stored = F.struct(kind.alias("type"), coordinates.alias("coordinates"))
    return kept.select(
        *[c for c in features.columns if c not in ("attributes", "geometry")],
        stored.alias("geometry"),
        tag_source_layer(F.col("attributes"), F.col("layer_name")).alias("properties"),
    )


def union_layers(*layers: DataFrame) -> DataFrame:
    """Features of all layers under one another; attributes a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


# --- stored features -------------------------------------------------------------------------------


def property_text(name: str, properties: str = "properties") -> Column:
    """A property as text; null where it is missing or null."""
    return F.col(properties).getItem(name).cast("string")


def non_empty_property(features: DataFrame, name: str) -> DataFrame:
    """Features whose property is there and is no empty text, list or object, zero or false; blanks and "0" are values."""
    value = F.col("properties").getItem(name)
    kind, text = F.schema_of_variant(value), property_text(name)
    empty = (
        F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), text.isin("[]", "{}"))
        .otherwise(text.try_cast("double") == 0)
    )
    return features.where(text.isNotNull() & ~F.coalesce(empty, F.lit(False)))


def non_blank_address(features: DataFrame, name: str) -> DataFrame:
    """Features whose address holds more than white space."""
    return features.where(F.length(strip(property_text(name))) > 0)


def strip_properties(features: DataFrame) -> DataFrame:
    """Geometry and id only."""
    only_id = F.create_map(F.lit("id"), F.col("id").cast("variant"))
    return features.select("id", "geometry", only_id.alias("properties"))


def feature_row_id(features: DataFrame, name: str = "id") -> DataFrame:
    """0-based id per collection, in file order (``source, pos`` come from the scan)."""
    return features.withColumn(name, F.col("pos").cast("bigint"))


def feature_global_id(features: DataFrame, name: str = "id") -> DataFrame:
    """0-based id over all collections, by file name and place in the file."""
    place = F.struct(F.col("source"), number_segment("pos"))
    numbered = ordered_row_number(features, ["source", "pos"], place, name="_no")
    return numbered.withColumn(name, F.col("_no") - 1).drop("_no")


def feature_count(features: DataFrame, by: Sequence[str] = ("layer_name",)) -> DataFrame:
    return features.groupBy(*by).agg(F.count("*").alias("feature_count"))


def distinct_codes(features: DataFrame, name: str, sample: int = 10) -> DataFrame:
    """Number of distinct property values, and the first few of them in order, as one row.

    Distinct values are found first; both summaries run over those. The sample is a top-k buffer of
    fixed size, not a sorted list of all values.
    """
    codes = non_empty_property(features, name).select(property_text(name).alias("code")).distinct()
    first = sorted_sample(codes, "code", sample)
    counted = codes.agg(F.count("*").alias("n_codes")).withColumn("sample", F.lit(None).cast("array<string>"))
    listed = first.agg(F.array_sort(F.collect_list("code")).alias("sample")).withColumn("n_codes", F.lit(None).cast("bigint"))
    return counted.unionByName(listed).agg(
        F.max("n_codes").alias("n_codes"), F.array_join(F.max("sample"), ",").alias("sample")
    )


def sorted_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` values in ascending order."""
    return df.orderBy(column).limit(n)


def feature_to_json(features: DataFrame) -> Column:
    """Feature text of a row with ``geometry`` and typed ``properties``; coordinates are spliced in as they are."""
    properties = F.to_json(F.col("properties"))
    geometry = F.concat(
        F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}")
    )
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")),
        F.lit(',"properties":'), F.coalesce(properties, F.lit("{}")), F.lit("}"),
    )


def json_parse(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)

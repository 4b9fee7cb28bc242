"""Zone dimension, zone lookups and the layers of a web map."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.text import blank_to_null

# Zone value, code, name, colour, description.
ZONES = (
    ("C: Urban Core", "C", "Urban Core", "#E53935", "Historic downtown commercial area promoting walkability and mixed uses"),
    ("UC1: Urban Center 1", "UC1", "Urban Center 1", "#F4511E", "Walkable mix of uses adjacent to Urban Core"),
    ("UC2: Urban Center 2", "UC2", "Urban Center 2", "#FF7043", "Small mixed-use centers serving urban neighborhoods"),
    ("UN1: Urban Neighborhood 1", "UN1", "Urban Neighborhood 1", "#FFCA28", "Mixed residential with small-lot single-family and some multifamily"),
    ("UN2: Urban Neighborhood 2", "UN2", "Urban Neighborhood 2", "#FFE082", "Transitional neighborhood with larger lots than UN1"),
    ("SN1: Suburban Neighborhood 1", "SN1", "Suburban Neighborhood 1", "#81C784", "Single-family homes on varying lot sizes with some multifamily"),
    ("SN2: Suburban Neighborhood 2", "SN2", "Suburban Neighborhood 2", "#A5D6A7", "Primarily single-family homes with little multifamily"),
    ("SNC: Suburban Neighborhood Center", "SNC", "Suburban Neighborhood Center", "#4DB6AC", "Small mixed-use centers serving surrounding neighborhoods"),
    ("SC: Suburban Corridor", "SC", "Suburban Corridor", "#7986CB", "Single-use commercial development along corridors"),
    ("SE: Suburban Edge", "SE", "Suburban Edge", "#C5E1A5", "Large lots (1+ acre) with scattered residential"),
    ("MI: Major Institution/Civic Campus", "MI", "Major Institution", "#9575CD", "Educational campuses, hospitals, parks, cemeteries"),
    ("MI: Major UC2: Urban Center 2", "MI/UC2", "Major Institution / Urban Center 2", "#B39DDB", "Mixed institutional and urban center"),
    ("IL: Industrial Limited", "IL", "Industrial Limited", "#90A4AE", "Light industrial, clean manufacturing, warehousing"),
    ("IG: Industrial General", "IG", "Industrial General", "#78909C", "Large footprint buildings for industrial development"),
    ("NO: Natural/Open Space", "NO", "Natural & Open Space", "#2E7D32", "Areas intended to remain in natural state"),
)
DEFAULT_COLOR = "#888888"

# Class value, label and colour (RGBA) of the zoning layer.
RENDERER_CLASSES = (
    ("OS", "OS", (225, 225, 225, 255)),
    ("A-5", "A-5", (65, 194, 0, 255)),
    ("A-20", "A-20", (56, 168, 0, 255)),
    ("PUD", "PUD", (139, 90, 43, 255)),
    ("PUD-R", "PUD-R", (139, 90, 43, 255)),
    ("PUD-C", "PUD-C", (237, 81, 81, 255)),
    ("PCD", "PCD", (205, 170, 102, 255)),
    ("MH", "MH", (230, 76, 0, 255)),
    ("R-3", "R-3", (255, 165, 0, 255)),
    ("R-2", "R- 2", (255, 211, 127, 255)),
    ("R-1-6", "R-1-6", (255, 215, 0, 255)),
    ("R-1-8", "R-1-8", (255, 140, 0, 255)),
    ("R-1-10", "R-1-10", (255, 255, 0, 255)),
    ("R-1-12", "R-1-12", (255, 247, 153, 255)),
    ("R-1-15", "R-1-15", (255, 255, 115, 255)),
    ("R-1-20", "R-1-20", (255, 255, 224, 255)),
    ("R-1-30", "R-1-30", (255, 255, 224, 255)),
    ("RA-1/2", "RA-1/2", (38, 115, 0, 255)),
    ("RA-1", "RA-1", (112, 168, 0, 255)),
    ("RA-2", "RA-2", (170, 255, 0, 255)),
    ("RA-5", "RA-5", (209, 255, 115, 255)),
    ("C-3", "C-3", (168, 0, 0, 255)),
    ("C-2", "C-2", (230, 0, 0, 255)),
    ("C-1", "C-1", (255, 190, 190, 255)),
    ("I", "I", (101, 127, 241, 255)),
    ("I-1", "I-1", (161, 33, 240, 255)),
    ("I-2", "I-2", (197, 135, 243, 255)),
    ("DM", "DM", (190, 232, 255, 255)),
    ("BP", "BP", (101, 199, 234, 255)),
    ("AP", "AP", (0, 112, 255, 255)),
)

# Row filters of the zoning layer and of the rental overlay.
ZONING_FILTER = "(ZONEDESC <> 'Residential Rental Short Term') AND (ZONEDESC <> 'Historical District')"
RENTAL_FILTER = "ZONEDESC = 'Residential Rental Short Term'"


def _literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A local relation: the planner knows its size and broadcasts it by its own rule."""
    return spark.createDataFrame(pa.table({name: list(column) for name, column in zip(names, zip(*rows))}))


def zone_dim(spark: SparkSession) -> DataFrame:
    """The zone dimension: 15 literal rows, so a broadcast of it has a fixed size."""
    return _literal_table(spark, ("zone", "code", "name", "color", "description"), ZONES)


def renderer_classes(spark: SparkSession) -> DataFrame:
    """The classes of the zoning layer: 30 literal rows."""
    rows = _literal_table(spark, ("value", "label", "color"), RENDERER_CLASSES)
    return rows.withColumn("color", F.col("color").cast("array<int>"))


def zone_code(zone: Column) -> Column:
    """Code before the colon, the whole value if there is none, empty for null."""
    return F.coalesce(blank_to_null(F.regexp_extract(zone, "^([A-Z0-9]+):", 1)), zone, F.lit(""))


def feature_title(zoneclass: Column) -> Column:
    return F.concat(F.lit("Zoning: "), zoneclass)


def popup_format(features: DataFrame, acres: str = "ACRES", dates: Sequence[str] = ("CreationDate", "EditDate")) -> DataFrame:
    """Display form of popup fields: acres with separators and two places, long dates."""
    shown = {acres: F.format_number(F.col(acres), 2)}
    shown |= {d: F.date_format(F.col(d), "MMMM d, yyyy") for d in dates}
    return features.withColumns(shown)


def zone_lookup(features: DataFrame, zones: DataFrame, column: str = "zone") -> DataFrame:
    """Zone code, name, colour and description; null for unknown values.

    The side of the dimension is left to the planner: it broadcasts a small one by its known size.
    """
    info = zones.select(F.col("zone").alias("_zone"), "code", "name", "color", "description")
    return features.join(info, F.col(column) == F.col("_zone"), "left").drop("_zone")


def zone_color(features: DataFrame, zones: DataFrame, default: str = DEFAULT_COLOR, column: str = "zone") -> DataFrame:
    colors = zones.select(F.col("zone").alias("_zone"), F.col("color").alias("_color"))
    joined = features.join(colors, F.col(column) == F.col("_zone"), "left")
    return joined.withColumn("color", F.coalesce("_color", F.lit(default))).drop("_zone", "_color")


def renderer_class_lookup(features: DataFrame, classes: DataFrame, column: str = "ZONECLASS") -> DataFrame:
    """Class label and colour; there is no default class."""
    known = classes.select(F.col("value").alias("_value"), F.col("label").alias("class_label"), "color")
    return features.join(known, F.col(column) == F.col("_value"), "left").drop("_value")


def zone_inventory(features: DataFrame, zones: DataFrame) -> DataFrame:
    """Features per zone of the dimension, zones without features included, unknown ones apart."""
    counted = features.groupBy("zone").agg(F.count("*").alias("features"))
    known = zones.select("zone", F.lit(True).alias("in_dimension"))
    joined = known.join(counted, "zone", "full")
    return joined.select(
        "zone", F.coalesce("in_dimension", F.lit(False)).alias("in_dimension"),
        F.coalesce("features", F.lit(0)).cast("bigint").alias("features"),
    )


# What a layer filter may consist of, besides the allowed columns.
_FILTER_TOKEN = re.compile(
    r"\s+|(?P<text>'[^'\\]*')|(?P<number>\d+(?:\.\d+)?)|(?P<op><>|<=|>=|=|<|>|\(|\)|,)|(?P<name>[A-Za-z_]\w*)"
)
_FILTER_WORDS = {"and", "or", "not", "in", "is", "null", "like", "between"}


def layer_definition_filter(features: DataFrame, expression: str, allowed_columns: Sequence[str]) -> DataFrame:
    """Features a layer's SQL filter keeps. Rows whose filter is NULL are dropped, as in SQL.

    The text comes from a document, so it is checked against an allow-list of columns, operators and
    literals before Spark sees it; anything else is an error.
    """
    columns = {c.lower() for c in allowed_columns}
    at = 0
    while at < len(expression):
        token = _FILTER_TOKEN.match(expression, at)
        if token is None or (token["name"] and token["name"].lower() not in columns | _FILTER_WORDS):
            raise ValueError(f"layer filter not allowed at position {at}: {expression!r}")
        at = token.end()
    return features.where(expression)


# --- web map documents -----------------------------------------------------------------------------


def webmap_layers(webmaps: DataFrame) -> DataFrame:
    """One row per operational layer, in drawing order."""
    layers = webmaps.select("map_id", F.posexplode("operationalLayers").alias("layer_no", "layer"))
    return layers.select(
        "map_id", "layer_no", "layer.title", "layer.url",
        F.col("layer.layerDefinition.definitionExpression").alias("definition_expression"),
        F.col("layer.layerDefinition.drawingInfo.renderer").alias("renderer"),
        F.col("layer.popupInfo").alias("popup"),
    )


def webmap_classes(webmaps: DataFrame) -> DataFrame:
    """One row per unique-value class of every layer; layers drawn with one symbol have none."""
    classes = webmap_layers(webmaps).select(
        "map_id", "layer_no", "title", F.posexplode("renderer.uniqueValueInfos").alias("class_no", "info")
    )
    return classes.select(
        "map_id", "layer_no", "title", "class_no", "info.value", "info.label", F.col("info.symbol.color").alias("color")
    )


def field_catalog(webmaps: DataFrame) -> DataFrame:
    """Visible and editable popup fields per layer, in popup order.

    Filtering the field array in place needs no explode and no regrouping.
    """
    fields = F.col("popup.fieldInfos")
    names = lambda keep: F.transform(F.filter(fields, keep), lambda f: f.fieldName)
    return webmap_layers(webmaps).select(
        "map_id", "layer_no", "title",
        names(lambda f: f.visible).alias("visible_fields"),
        names(lambda f: f.isEditable).alias("editable_fields"),
    )

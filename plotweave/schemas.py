"""Explicit schemas of landed data. Nothing is inferred: layers differ in their attributes."""

MANIFEST_ENTRY = "md5 STRING, relpath STRING"
MANIFEST_ARRAY = f"ARRAY<STRUCT<{MANIFEST_ENTRY}>>"

CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")
CORNER_COLUMNS = tuple(f"{corner}_{axis}" for corner in CORNERS for axis in ("lng", "lat"))

#: One stored feature. Coordinates stay JSON text, because their nesting differs by geometry type; properties keep their
#: JSON types (numbers, booleans, nulls, nested values).
FEATURE = (
    "STRUCT<type: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>,"
    " properties: MAP<STRING, VARIANT>>"
)
FEATURE_COLLECTION = f"type STRING, features ARRAY<{FEATURE}>, crs STRING, error STRING"

#: One response of a feature service in its own JSON dialect.
SERVICE_FEATURE = (
    "STRUCT<attributes: MAP<STRING, VARIANT>, geometry: STRUCT<"
    "rings: ARRAY<ARRAY<ARRAY<DOUBLE>>>, paths: ARRAY<ARRAY<ARRAY<DOUBLE>>>, x: DOUBLE, y: DOUBLE>>"
)
SERVICE_PAGE_BODY = f"features ARRAY<{SERVICE_FEATURE}>, error STRING"

#: Envelope a page is landed in: which request it answers, and the untouched body.
LANDED_PAGE = "layer_id INT, layer_name STRING, page_no BIGINT, status INT, body STRING"

SERVICE_INFO = "service STRING, layers ARRAY<STRUCT<id: INT, name: STRING>>"
LAYER_INFO = "service STRING, id INT, supportsPagination BOOLEAN, maxRecordCount INT"

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"

WEBMAP_LAYER = (
    "STRUCT<title: STRING, url: STRING,"
    " layerDefinition: STRUCT<definitionExpression: STRING, drawingInfo: STRUCT<renderer: STRUCT<"
    "type: STRING, field1: STRING,"
    " uniqueValueInfos: ARRAY<STRUCT<label: STRING, value: STRING, symbol: STRUCT<color: ARRAY<INT>>>>>>>,"
    " popupInfo: STRUCT<title: STRING,"
    " expressionInfos: ARRAY<STRUCT<name: STRING, title: STRING, expression: STRING>>,"
    " fieldInfos: ARRAY<STRUCT<fieldName: STRING, label: STRING, visible: BOOLEAN, isEditable: BOOLEAN>>>>"
)
WEBMAP = f"map_id STRING, operationalLayers ARRAY<{WEBMAP_LAYER}>"

TOC = "root_heading STRING, root_id STRING, children ARRAY<STRUCT<heading: STRING, node_id: STRING>>"

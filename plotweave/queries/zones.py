"""Zone dimension and web maps."""

from pyspark.sql import functions as F

from plotweave.fixtures import frame, table
from plotweave.functions.urls import ordinance_link
from plotweave.operators import zones as op
from plotweave.queries.registry import query
from plotweave.session import staging_path
from plotweave.sources import landed


@query("zone_dim", """
    SELECT z.zone, z.code, z.color, count(f.id) AS features FROM {zones} AS z LEFT JOIN {features} AS f USING (zone)
    GROUP BY z.zone, z.code, z.color""")
def _(spark, sf):
    """The dimension with the number of features that use each entry."""
    used = frame(spark, sf, "features").groupBy("zone").agg(F.count("*").alias("features"))
    dim = op.zone_dim(spark).join(used, "zone", "left")
    return dim.select("zone", "code", "color", F.coalesce("features", F.lit(0)).cast("bigint").alias("features"))


@query("zone_lookup", """
    SELECT f.id, z.code, z.name, z.color, z.description FROM {features} AS f LEFT JOIN {zones} AS z USING (zone)""")
def _(spark, sf):
    return op.zone_lookup(frame(spark, sf, "features"), op.zone_dim(spark)).select("id", "code", "name", "color", "description")


@query("zone_color", "SELECT f.id, coalesce(z.color, '#888888') AS color FROM {features} AS f LEFT JOIN {zones} AS z USING (zone)")
def _(spark, sf):
    return op.zone_color(frame(spark, sf, "features"), op.zone_dim(spark)).select("id", "color")


@query("zone_code", """
    SELECT id, coalesce(nullif(regexp_extract(v, '^([A-Z0-9]+):', 1), ''), v, '') AS code
    FROM (SELECT id, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 19 = 1 THEN '' ELSE zone END AS v FROM {features} AS f) AS x""")
def _(spark, sf):
    value = F.when(F.col("id") % 19 == 0, F.lit(None)).when(F.col("id") % 19 == 1, "").otherwise(F.col("zone"))
    return frame(spark, sf, "features").select("id", op.zone_code(value).alias("code"))


@query("zone_inventory", """
    SELECT coalesce(z.zone, f.zone) AS zone, z.zone IS NOT NULL AS in_dimension, coalesce(f.n, 0) AS features
    FROM {zones} AS z FULL JOIN (SELECT zone, count(*) AS n FROM {features} AS x GROUP BY zone) AS f USING (zone)""")
def _(spark, sf):
    return op.zone_inventory(frame(spark, sf, "features"), op.zone_dim(spark))


@query("renderer_class_lookup", """
    SELECT p.id, c.label AS class_label, c.color FROM {parcels} AS p LEFT JOIN {classes} AS c ON c.value = p.ZONECLASS""")
def _(spark, sf):
    drawn = op.renderer_class_lookup(frame(spark, sf, "parcels"), op.renderer_classes(spark))
    color = F.when(F.col("color").isNotNull(), F.array_join(F.transform("color", lambda c: c.cast("string")), "/"))
    return drawn.select("id", "class_label", color.alias("color"))


_COLUMNS = ("ZONEDESC", "ZONECLASS", "ACRES")


@query("layer_definition_filter", """
    SELECT id, 'zoning' AS layer FROM {parcels} AS p WHERE ZONEDESC <> 'Residential Rental Short Term' AND ZONEDESC <> 'Historical District'
    UNION ALL SELECT id, 'rental' FROM {parcels} AS p WHERE ZONEDESC = 'Residential Rental Short Term'""")
def _(spark, sf):
    parcels = frame(spark, sf, "parcels")
    layer = lambda name, text: op.layer_definition_filter(parcels, text, _COLUMNS).select("id", F.lit(name).alias("layer"))
    return layer("zoning", op.ZONING_FILTER).unionByName(layer("rental", op.RENTAL_FILTER))


@query("ordinance_link", """
    SELECT id, 'https://codes.example.com/latest/' || replace(replace(OnlineCode, ' ', '%20'), '&', '%26') AS link FROM {parcels} AS p""")
def _(spark, sf):
    return frame(spark, sf, "parcels").select("id", ordinance_link(F.col("OnlineCode"), "https://codes.example.com/latest/").alias("link"))


@query("feature_title", "SELECT id, 'Zoning: ' || ZONECLASS AS title FROM {parcels} AS p")
def _(spark, sf):
    return frame(spark, sf, "parcels").select("id", op.feature_title(F.col("ZONECLASS")).alias("title"))


@query("popup_format", """
    SELECT id, CASE WHEN cents < 100000 THEN CAST(cents // 100 AS VARCHAR)
                    ELSE CAST(cents // 100000 AS VARCHAR) || ',' || lpad(CAST((cents // 100) % 1000 AS VARCHAR), 3, '0') END ||
               '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS ACRES,
           strftime(DATE '2023-01-01' + CAST(day_no AS INTEGER), '%B %-d, %Y') AS CreationDate
    FROM (SELECT id, day_no, CAST(round(ACRES * 100) AS BIGINT) AS cents FROM {parcels} AS p) AS x""")
def _(spark, sf):
    dated = frame(spark, sf, "parcels").withColumn("CreationDate", F.date_add(F.lit("2023-01-01").cast("date"), F.col("day_no").cast("int")))
    return op.popup_format(dated, dates=["CreationDate"]).select("id", "ACRES", "CreationDate")


def _webmaps(spark, sf):
    """A web map document per supplier: a zoning layer with classes and a rental overlay without."""
    classes = [
        F.struct(F.lit(label).alias("label"), F.lit(value).alias("value"), F.struct(F.array(*map(F.lit, color)).alias("color")).alias("symbol"))
        for value, label, color in op.RENDERER_CLASSES
    ]
    no_classes = F.array().cast("array<struct<label:string,value:string,symbol:struct<color:array<int>>>>")

    def field(name, visible, editable):
        return F.struct(F.lit(name).alias("fieldName"), F.lit(name.title()).alias("label"), visible.alias("visible"), editable.alias("isEditable"))

    odd = F.col("s_suppkey") % 2 == 1

    def layer(title, text, kind, infos):
        renderer = F.struct(F.lit(kind).alias("type"), F.lit("ZONECLASS").alias("field1"), infos.alias("uniqueValueInfos"))
        fields = F.array(
            field("OBJECTID", F.lit(False), F.lit(False)), field("ZONECLASS", odd, F.lit(True)),
            field("ACRES", F.lit(True), odd), field("Creator", F.lit(False), F.lit(False)),
        )
        link = F.struct(F.lit("expr0").alias("name"), F.lit("Online Ordinance").alias("title"), F.lit("UrlEncode($feature.OnlineCode)").alias("expression"))
        return F.struct(
            F.lit(title).alias("title"), F.concat(F.lit("https://services.example.com/"), "s_name", F.lit("/0")).alias("url"),
            F.struct(F.lit(text).alias("definitionExpression"), F.struct(renderer.alias("renderer")).alias("drawingInfo")).alias("layerDefinition"),
            F.struct(F.lit("Zoning: {ZONECLASS}").alias("title"), F.array(link).alias("expressionInfos"), fields.alias("fieldInfos")).alias("popupInfo"),
        )

    layers = F.array(
        layer("Zoning", op.ZONING_FILTER, "uniqueValue", F.array(*classes)), layer("Rental", op.RENTAL_FILTER, "simple", no_classes)
    )
    path = staging_path(spark, "webmaps")
    table(spark, sf, "supplier").select(F.col("s_name").alias("map_id"), layers.alias("operationalLayers")).write.json(path)
    return landed.webmap_layer_scan(spark, path)


@query("webmap_layer_scan", """
    SELECT s_name AS map_id, n AS layer_no, CASE n WHEN 0 THEN 'Zoning' ELSE 'Rental' END AS title,
           CASE n WHEN 0 THEN '(ZONEDESC <> ''Residential Rental Short Term'') AND (ZONEDESC <> ''Historical District'')'
                  ELSE 'ZONEDESC = ''Residential Rental Short Term''' END AS definition_expression,
           CASE n WHEN 0 THEN 30 ELSE 0 END AS n_classes, 1 AS n_expressions
    FROM {supplier}, (VALUES (0), (1)) AS l(n)""")
def _(spark, sf):
    layers = op.webmap_layers(_webmaps(spark, sf))
    return layers.select(
        "map_id", "layer_no", "title", "definition_expression",
        F.size("renderer.uniqueValueInfos").alias("n_classes"), F.size("popup.expressionInfos").alias("n_expressions"),
    )


@query("webmap_classes", """
    SELECT s_name AS map_id, CAST(c.i AS INTEGER) AS class_no, c.value, c.label, c.color FROM {supplier}, {classes} AS c""")
def _(spark, sf):
    classes = op.webmap_classes(_webmaps(spark, sf))
    color = F.array_join(F.transform("color", lambda c: c.cast("string")), "/")
    return classes.select("map_id", "class_no", "value", "label", color.alias("color"))


@query("field_catalog", """
    SELECT s_name AS map_id, n AS layer_no, CASE WHEN s_suppkey % 2 = 1 THEN 'ZONECLASS,ACRES' ELSE 'ACRES' END AS visible,
           CASE WHEN s_suppkey % 2 = 1 THEN 'ZONECLASS,ACRES' ELSE 'ZONECLASS' END AS editable
    FROM {supplier}, (VALUES (0), (1)) AS l(n)""")
def _(spark, sf):
    fields = op.field_catalog(_webmaps(spark, sf))
    return fields.select("map_id", "layer_no", F.array_join("visible_fields", ",").alias("visible"), F.array_join("editable_fields", ",").alias("editable"))

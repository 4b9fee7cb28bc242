"""Feature services, conversion, union and export."""

from pyspark.sql import functions as F

from plotweave.fixtures import frame, landed_service_pages, stored_features, table
from plotweave.operators import features as op
from plotweave.queries.registry import query
from plotweave.session import staging_path
from plotweave.sources import landed, sinks


@query("geojson_scan", "SELECT id, zone, street FROM {features} AS f")
def _(spark, sf):
    path = staging_path(spark, "collections")
    features = stored_features(spark, sf).withColumn("pos", F.floor(F.col("id") / 17)).withColumn("part", F.col("id") % 17)
    sinks.geojson_collections_sink(features, path, "part", 50)
    read = landed.geojson_scan(spark, path)
    value = op.property_text
    return read.select(value("id").cast("bigint").alias("id"), value("Zone_2024").alias("zone"), value("STREET_ADD").alias("street"))


@query("geojson_split_scan", "SELECT id, zone, street, TRUE AS gapless FROM {features} AS f")
def _(spark, sf):
    """The same features, each file cut where a feature opens; places in a file go from 0 without gaps."""
    path = staging_path(spark, "collections")
    features = stored_features(spark, sf).withColumn("pos", F.floor(F.col("id") / 17)).withColumn("part", F.col("id") % 17)
    sinks.geojson_collections_sink(features, path, "part", 50)
    value = op.property_text
    read = landed.geojson_split_scan(spark, path).select(
        "source", "pos", value("id").cast("bigint").alias("id"), value("Zone_2024").alias("zone"), value("STREET_ADD").alias("street"))
    files = read.groupBy("source").agg(((F.max("pos") + 1 == F.count("*")) & (F.countDistinct("pos") == F.count("*"))).alias("gapless"))
    return read.join(files, "source").select("id", "zone", "street", "gapless")


def _landed(spark, sf):
    path = staging_path(spark, "pages")
    landed_service_pages(spark, sf).write.json(path)
    return landed.feature_page_scan(spark, path)


_GOOD = """{service_features} AS f JOIN {service_pages} AS p USING (layer_id, page_no) WHERE p.outcome = 'good'"""


@query("feature_page_scan", f"SELECT f.layer_id, page_no, CAST(f.id AS VARCHAR) AS object_id FROM {_GOOD}")
def _(spark, sf):
    features = op.page_features(_landed(spark, sf))
    return features.select("layer_id", "page_no", op.property_text("OBJECTID", "attributes").alias("object_id"))


@query("has_geometry", f"SELECT f.layer_id, f.id FROM {_GOOD} AND kind NOT IN ('none', 'curve')")
def _(spark, sf):
    features = op.has_geometry(op.page_features(_landed(spark, sf)))
    return features.select("layer_id", F.col("attributes")["OBJECTID"].cast("bigint").alias("id"))


_X = "CAST(CAST(id % 50 * 100 + {} AS DOUBLE) AS VARCHAR)"
_Y = "CAST(CAST(id % 60 * 100 + {} AS DOUBLE) AS VARCHAR)"


def _pt(dx, dy):
    return f"'[' || {_X.format(dx)} || ',' || {_Y.format(dy)} || ']'"


_RING = "'[[' || " + " || ',' || ".join(_pt(*d) for d in ((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))) + " || ']]'"
_PATH = "'[' || " + " || ',' || ".join(_pt(*d) for d in ((0, 0), (50, 50))) + " || ']'"


@query("esri_to_geojson", f"""
    SELECT f.id, CASE kind WHEN 'rings' THEN 'Polygon' WHEN 'paths' THEN 'LineString' ELSE 'Point' END AS type,
           CASE kind WHEN 'rings' THEN {_RING} WHEN 'paths' THEN {_PATH} ELSE {_pt(0, 0)} END AS coordinates
    FROM {_GOOD} AND kind NOT IN ('none', 'curve')""")
def _(spark, sf):
    stored = op.esri_to_geojson(op.page_features(_landed(spark, sf)))
    return stored.select(F.col("properties")["OBJECTID"].cast("bigint").alias("id"), "geometry.type", "geometry.coordinates")


@query("esri_multipolygons", """
    SELECT id, CASE WHEN count(*) > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
           CASE WHEN count(*) > 1 THEN '[' || string_agg(polygon, ',' ORDER BY shell) || ']' ELSE min(polygon) END AS coordinates
    FROM (SELECT id, part_no, min(ring_no) FILTER (WHERE hole = 0) AS shell, '[' || string_agg(ring, ',' ORDER BY hole, ring_no) || ']' AS polygon
          FROM (SELECT id, part_no, hole, ring_no, '[' || string_agg('[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']', ',' ORDER BY vertex_no) || ']' AS ring
                FROM {nested_vertices} AS v GROUP BY id, part_no, hole, ring_no) AS r GROUP BY id, part_no) AS p
    GROUP BY id""")
def _(spark, sf):
    """Rings of every feature, in the order they are stored, as polygons and multipolygons."""
    vertex = F.struct("vertex_no", F.array("x", "y").alias("v"))
    ring = F.transform(F.array_sort(F.collect_list(vertex)), lambda v: v.v)
    rings = frame(spark, sf, "nested_vertices").groupBy("id", "ring_no").agg(ring.alias("ring"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))), lambda r: r.ring)
    none = F.lit(None)
    features = rings.groupBy("id").agg(nested.alias("rings")).select(
        "id", F.lit("parcels").alias("layer_name"), none.cast("map<string,variant>").alias("attributes"),
        F.struct("rings", none.cast("array<array<array<double>>>").alias("paths"), none.cast("double").alias("x"), none.cast("double").alias("y")).alias("geometry"))
    return op.esri_to_geojson(features, nest=True).select("id", "geometry.type", "geometry.coordinates")


@query("tag_source_layer", f"""
    SELECT f.id, f.layer_name AS source_layer, p_name AS name FROM {_GOOD} AND kind NOT IN ('none', 'curve')""")
def _(spark, sf):
    stored = op.esri_to_geojson(op.page_features(_landed(spark, sf)))
    value = op.property_text
    return stored.select(value("OBJECTID").cast("bigint").alias("id"), value("_source_layer").alias("source_layer"), value("NAME").alias("name"))


@query("feature_count", f"""
    SELECT f.layer_name, count(*) AS feature_count FROM {_GOOD} AND kind NOT IN ('none', 'curve') GROUP BY f.layer_name""")
def _(spark, sf):
    return op.feature_count(op.esri_to_geojson(op.page_features(_landed(spark, sf))))


@query("union_layers", """
    SELECT id, zone, street, NULL::VARCHAR AS sheet FROM {features} AS f WHERE id % 2 = 0
    UNION ALL SELECT id, zone, NULL, sheet FROM {features} AS f WHERE id % 2 = 1""")
def _(spark, sf):
    flat = frame(spark, sf, "features")
    layers = op.union_layers(
        flat.where("id % 2 = 0").select("id", "zone", "street"), flat.where("id % 2 = 1").select("id", "zone", "sheet")
    )
    return layers.select("id", "zone", "street", "sheet")


@query("empty_response_check", """
    SELECT CAST(layer_id AS VARCHAR) || '/' || CAST(page_no AS VARCHAR) AS key, 'has_response' AS rule, outcome <> 'blank' AS passed
    FROM {service_pages} AS p""")
def _(spark, sf):
    return op.empty_response_check(_landed(spark, sf))


@query("service_error_check", """
    SELECT CAST(layer_id AS VARCHAR) || '/' || CAST(page_no AS VARCHAR) AS key, 'no_service_error' AS rule, outcome <> 'error' AS passed
    FROM {service_pages} AS p""")
def _(spark, sf):
    return op.service_error_check(_landed(spark, sf))


@query("layer_isolation", """
    SELECT CAST(layer_id AS VARCHAR) AS key, 'layer_complete' AS rule, count(*) FILTER (WHERE outcome <> 'good') = 0 AS passed,
           count(*) FILTER (WHERE outcome = 'good') AS good_pages, count(*) FILTER (WHERE outcome <> 'good') AS failed_pages
    FROM {service_pages} AS p GROUP BY layer_id""")
def _(spark, sf):
    return op.layer_isolation(_landed(spark, sf))


def _geojson_pages(spark, sf):
    """Stored features as landed GeoJSON responses of 40 features, by layer."""
    features = stored_features(spark, sf).withColumn("layer_id", (F.col("id") % 5).cast("int"))
    placed = features.withColumn("pos", F.floor(F.col("id") / 5)).withColumn("page_no", F.floor(F.col("pos") / 40))
    texts = F.array_sort(F.collect_list(F.struct("pos", op.feature_to_json(placed).alias("text"))))
    pages = placed.groupBy("layer_id", "page_no").agg(F.array_join(F.transform(texts, lambda t: t.text), ",").alias("_f"))
    crs = F.concat(F.lit('"crs":{"type":"name","properties":{"name":"EPSG:'), (4326 + F.col("layer_id")).cast("string"), F.lit('"}},'))
    body = F.concat(F.lit('{"type":"FeatureCollection",'), crs, F.lit('"features":['), F.col("_f"), F.lit("]}"))
    return pages.select("layer_id", F.lit("zoning").alias("layer_name"), "page_no", F.lit(200).alias("status"), body.alias("body"))


@query("geojson_page_scan", """
    SELECT CAST(id % 5 AS INTEGER) AS layer_id, CAST(floor(floor(id / 5) / 40) AS BIGINT) AS page_no, id, zone,
           '{{\"type\":\"name\",\"properties\":{{\"name\":\"EPSG:' || CAST(4326 + id % 5 AS VARCHAR) || '\"}}}}' AS crs
    FROM {features} AS f""".replace("{{", "{").replace("}}", "}"))
def _(spark, sf):
    path = staging_path(spark, "geojson-pages")
    _geojson_pages(spark, sf).write.json(path)
    read = landed.geojson_page_scan(spark, path).join(landed.page_crs(spark, path), "layer_id")
    return read.select(
        "layer_id", "page_no", F.col("properties")["id"].cast("bigint").alias("id"), op.property_text("Zone_2024").alias("zone"), "crs"
    )


@query("page_plan", """
    SELECT o_custkey, k AS page_no, CAST(k * 3 AS BIGINT) AS result_offset
    FROM (SELECT c_custkey AS o_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS total FROM {customer}) AS t,
         generate_series(0, 100000) AS g(k) WHERE k * 3 < total""")
def _(spark, sf):
    """Requests per layer, a layer being a customer and its features the orders; some have none."""
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    layers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(totals, "o_custkey", "left")
    planned = op.page_plan(layers, F.coalesce("total", F.lit(0)), F.lit(3))
    return planned.select("o_custkey", "page_no", "result_offset")


@query("id_chunk_plan", """
    SELECT o_orderpriority, chunk_no, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS object_ids, count(*) AS n_ids
    FROM (SELECT o_orderpriority, o_orderkey,
                 CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS chunk_no
          FROM {orders}) AS n GROUP BY o_orderpriority, chunk_no""")
def _(spark, sf):
    return op.id_chunk_plan(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 100)


@query("page_slice", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderkey LIMIT 500 OFFSET 700")
def _(spark, sf):
    return op.page_slice(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000), 700, 500)


def _services(spark, sf):
    """One service per supplier, its layers the regions."""
    wanted = table(spark, sf, "supplier").select("s_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey"))
    layers = wanted.join(table(spark, sf, "region"), "r_regionkey")
    layer = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return layers.groupBy(F.col("s_name").alias("service")).agg(F.array_sort(F.collect_list(layer)).alias("layers"))


def _layer_info(spark, sf):
    """Paging abilities; missing for every third layer, partly empty for others."""
    layers = table(spark, sf, "supplier").select("s_name", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("id"))
    k = F.col("s_suppkey") + F.col("id")
    return layers.where(k % 3 != 0).select(
        F.col("s_name").alias("service"), "id", F.when(k % 3 == 1, F.lit(True)).alias("supportsPagination"),
        F.when(k % 2 == 0, (k + 500).cast("int")).alias("maxRecordCount"),
    )


_LAYERS = """
    SELECT s_name AS service, r_regionkey AS layer_id, r_name AS layer_name, (s_suppkey + r_regionkey) % 3 = 1 AS supports_pagination,
           CASE WHEN (s_suppkey + r_regionkey) % 3 <> 0 AND (s_suppkey + r_regionkey) % 2 = 0
                THEN CAST(s_suppkey + r_regionkey + 500 AS INTEGER) ELSE 1000 END AS max_record_count
    FROM {supplier}, {region}"""


@query("layer_catalog", _LAYERS)
def _(spark, sf):
    return op.layer_catalog(_services(spark, sf), _layer_info(spark, sf))


@query("layer_info_join", _LAYERS)
def _(spark, sf):
    layers = _services(spark, sf).select("service", F.inline("layers"))
    return op.layer_info_join(layers, _layer_info(spark, sf))


@query("item_info_scan", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'https://services.example.com/' || p_name || '/FeatureServer' END AS service_url FROM {part}""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    url = F.concat(F.lit("https://services.example.com/"), "p_name", F.lit("/FeatureServer"))
    body = F.when(k < 3, F.to_json(F.struct(F.col("p_name").alias("title"), url.alias("url")))).when(
        k == 3, F.lit('{"title":"x","url":""}')).otherwise(F.lit('{"title":"x"}'))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), body.alias("body"))
    found, missing = landed.item_info_scan(items)
    both = found.unionByName(missing, allowMissingColumns=True)
    return both.select(F.col("item_id").alias("p_partkey"), "service_url")


@query("non_empty_property", "SELECT id, sheet FROM {features} AS f WHERE sheet <> ''")
def _(spark, sf):
    kept = op.non_empty_property(stored_features(spark, sf), "QTRSEC_NUMBER")
    return kept.select("id", op.property_text("QTRSEC_NUMBER").alias("sheet"))


@query("non_blank_address", "SELECT id, street FROM {features} AS f WHERE trim(street) <> ''")
def _(spark, sf):
    kept = op.non_blank_address(stored_features(spark, sf), "STREET_ADD")
    return kept.select("id", op.property_text("STREET_ADD").alias("street"))


@query("distinct_codes", """
    SELECT count(*) AS n_codes, (SELECT string_agg(sheet, ',' ORDER BY sheet) FROM (
        SELECT DISTINCT sheet FROM {features} AS f WHERE sheet <> '' ORDER BY sheet LIMIT 10) AS s) AS sample
    FROM (SELECT DISTINCT sheet FROM {features} AS f WHERE sheet <> '') AS d""")
def _(spark, sf):
    return op.distinct_codes(stored_features(spark, sf), "QTRSEC_NUMBER")


@query("sorted_sample", "SELECT DISTINCT sheet FROM {features} AS f WHERE sheet <> '' ORDER BY sheet LIMIT 10")
def _(spark, sf):
    codes = frame(spark, sf, "features").where("sheet <> ''").select("sheet").distinct()
    return op.sorted_sample(codes, "sheet", 10)


def _exported(spark, path):
    read = landed.feature_lines_scan(spark, path)
    return read.select(F.col("properties")["id"].cast("bigint").alias("id"), "geometry.type", "geometry.coordinates", "properties")


_BOX = " || ',' || ".join(
    f"'[' || CAST(x0 + {dx} AS VARCHAR) || ',' || CAST(y0 + {dy} AS VARCHAR) || ']'" for dx, dy in ((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))
)
_EXPORT = f"SELECT id, 'Polygon' AS type, '[[' || {_BOX} || ']]' AS coordinates"


@query("geojson_export_full", f"""
    {_EXPORT}, '{{"area":' || CASE WHEN id % 4 = 0 THEN CAST(id // 4 AS VARCHAR) ELSE CAST(id / 4.0e0 AS VARCHAR) END ||
        ',"corners":[' || CAST(x0 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || '],"even":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END ||
        ',"id":' || CAST(id AS VARCHAR) || ',"note":null}}' AS typed, zone
    FROM {{features}} AS f""")
def _(spark, sf):
    """Numbers, booleans, nulls and lists come back with their types."""
    path = staging_path(spark, "export")
    sinks.geojson_export_full(stored_features(spark, sf), path)
    read = _exported(spark, path)
    names = ("area", "corners", "even", "id", "note")
    typed = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{n}":'), F.to_json(F.col("properties")[n])) for n in names]), ","), F.lit("}"))
    return read.select("id", "type", "coordinates", typed.alias("typed"), op.property_text("Zone_2024").alias("zone"))


@query("geojson_export_geometry_only", f"{_EXPORT}, 1 AS n_properties FROM {{features}} AS f")
def _(spark, sf):
    path = staging_path(spark, "export")
    sinks.geojson_export_geometry_only(stored_features(spark, sf), path)
    return _exported(spark, path).withColumn("n_properties", F.size("properties")).drop("properties")


@query("geojson_sink", """
    SELECT 'Zoning' AS layer_name, count(*) AS feature_count, 'https://services.example.com/0' AS url FROM {features} AS f""")
def _(spark, sf):
    path = staging_path(spark, "export")
    summary = sinks.geojson_sink(stored_features(spark, sf), path, "Zoning", "https://services.example.com/0")
    return summary.select("layer_name", "feature_count", "url")


@query("strip_properties", f"{_EXPORT}, CAST(id AS VARCHAR) AS only_property FROM {{features}} AS f")
def _(spark, sf):
    bare = op.strip_properties(stored_features(spark, sf).drop("zone"))
    only = F.map_values("properties")[0].cast("string")
    return bare.select("id", "geometry.type", "geometry.coordinates", only.alias("only_property"))


@query("feature_to_json", f"""
    SELECT id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || {_BOX} || ']]}},"properties":{{"id":' || CAST(id AS VARCHAR) || '}}}}' AS text
    FROM <features> AS f""".replace("<features>", "{features}"))
def _(spark, sf):
    bare = op.strip_properties(stored_features(spark, sf).drop("zone"))
    return bare.select("id", op.feature_to_json(bare).alias("text"))


@query("feature_row_id", """
    SELECT id AS feature, id % 200 AS row_id FROM {features} AS f""")
def _(spark, sf):
    """Ids by place in the collection; every collection holds 200 features."""
    path = staging_path(spark, "collections")
    features = stored_features(spark, sf).withColumn("pos", F.col("id") % 200).withColumn("part", F.floor(F.col("id") / 200))
    sinks.geojson_collections_sink(features, path, "part", 200)
    read = op.feature_row_id(landed.geojson_scan(spark, path), "row_id")
    return read.select(F.col("properties")["id"].cast("bigint").alias("feature"), "row_id")


@query("feature_global_id", """
    SELECT id AS feature, row_number() OVER (ORDER BY id % 17, id) - 1 AS row_id FROM {features} AS f""")
def _(spark, sf):
    """Ids over all collections, ordered by collection and place."""
    placed = stored_features(spark, sf).select(
        F.format_string("part-%03d", F.col("id") % 17).alias("source"), F.floor(F.col("id") / 17).alias("pos"), F.col("id").alias("feature"))
    return op.feature_global_id(placed, "row_id").select("feature", "row_id")

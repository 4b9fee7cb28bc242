"""Readers, writers and the feature service format."""

import json
import os
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.fixtures import stored_features
from plotweave.functions import markup
from plotweave.operators import catalog as cat
from plotweave.operators import discovery as disc
from plotweave.operators import features as ft
from plotweave.operators import zones
from plotweave.sources import feature_service, landed, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


# --- manifest --------------------------------------------------------------------------------------


def test_manifest_order_is_file_order(spark, tmp_path):
    entries = [{"md5": f"h{i}", "relpath": f"maps/x/{i % 3}.pdf"} for i in range(9)]
    (tmp_path / "m.json").write_text(json.dumps(entries, indent=2))
    read = landed.manifest_scan(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [r.md5 for r in read] == [e["md5"] for e in entries]


def test_manifest_shards_keep_the_order(spark, tmp_path):
    manifest = spark.range(100).select(
        F.concat(F.lit("h"), "id").alias("md5"), F.concat(F.lit("maps/"), F.col("id") % 10).alias("relpath"), F.col("id").alias("ord"))
    path = str(tmp_path / "m")
    sinks.manifest_sink(manifest, path, per_shard=7)
    read = landed.manifest_scan(spark, path)
    assert [r.md5 for r in read.orderBy("ord").collect()] == [f"h{i}" for i in range(100)]
    first = cat.hash_by_path(spark.createDataFrame([("3",), ("nope",)], "path STRING"), read).collect()
    assert {r.path: r.md5 for r in first} == {"3": "h3", "nope": None}


@pytest.mark.parametrize("layout", [{"separators": (",", ":")}, {}, {"indent": 2}])
def test_one_huge_manifest_is_read_by_many_tasks(spark, tmp_path, layout):
    """Two shards; paths that hold borders, braces and quotes."""
    odd = ['"md5"', '},{"md5":', "]}", "ü", "\\", "[{"]
    for shard, n in (("part-2", 3000), ("part-10", 500)):
        entries = [{"md5": f"h{shard}{i}", "relpath": f"maps/{i}/{odd[i % 6]}.pdf"} for i in range(n)]
        (tmp_path / f"{shard}.json").write_text(json.dumps(entries, **layout))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        scan = landed.manifest_split_scan(spark, str(tmp_path))
        assert spark.read.option("lineSep", '"md5"').text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((r.ord, r.md5, r.relpath) for r in scan.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    whole = landed.manifest_scan(spark, str(tmp_path)).collect()
    assert len(got) == 3500 and got == sorted((r.ord, r.md5, r.relpath) for r in whole)


def test_split_manifest_is_whole_or_fails(spark, tmp_path):
    good = [{"md5": "a", "relpath": "x"}, {"md5": "b", "relpath": "y"}]
    bad = {"turned": json.dumps([dict(reversed(e.items())) for e in good]), "short": json.dumps(good)[:-8], "no path": '[{"md5": "a"}]', "object": "{}",
           "cut": json.dumps(good)[:-1], "value": json.dumps([{"md5": "a", "relpath": "md5"}]), "html": "<html>no</html>"}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="md5 first"):
            landed.manifest_split_scan(spark, str(tmp_path / f"{name}.json")).collect()
    (tmp_path / "none.json").write_text(" [ ]\n")
    assert landed.manifest_split_scan(spark, str(tmp_path / "none.json")).count() == 0


def test_broken_manifest_fails(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"md5": "a", ')
    with pytest.raises(Exception):
        landed.manifest_scan(spark, str(tmp_path / "m.json")).collect()


def test_manifest_version_takes_the_first_pin(spark, tmp_path):
    (tmp_path / "data.pin").write_text("outs:\n- md5: 0123456789abcdef0123456789abcdef.dir\n  size: 1\n- md5: 00.dir\n")
    pins = landed.pin_lines(spark, str(tmp_path))
    assert [r.manifest_id for r in cat.manifest_version(pins).collect()] == ["0123456789abcdef0123456789abcdef"]
    assert [r.manifest_id for r in cat.manifest_version(pins, "ffff").collect()] == ["ffff"]


def test_candidate_paths(spark):
    df = spark.createDataFrame([("AL/town/a/b.json",), ("AL/town/geojson/b.json",), ("x.json",)], "path STRING")
    got = [r[0] for r in df.select(cat.candidate_paths(F.col("path"))).collect()]
    assert got[0] == ["maps/AL/town/a/b.json", "maps/AL/town/geojson/a/b.json"]
    assert got[1] == ["maps/AL/town/geojson/b.json", "maps/AL/town/geojson/geojson/b.json"]
    assert got[2][0] == "maps/x.json"


def test_manifest_diff_of_copies(spark):
    """Removing one of many copies and adding two elsewhere: each path appears once."""
    old = spark.createDataFrame([("h", "a", 0), ("h", "b", 1), ("k", "c", 2)], "md5 STRING, relpath STRING, ord BIGINT")
    new = spark.createDataFrame([("h", "b", 0), ("h", "d", 1), ("h", "e", 2), ("z", "c", 3), ("y", "f", 4)], "md5 STRING, relpath STRING, ord BIGINT")
    got = {r.relpath: (r.status, r.moved_from) for r in cat.manifest_diff(old, new).collect()}
    assert got == {"a": ("removed", None), "b": ("unchanged", None), "c": ("modified", None),
                   "d": ("moved", "a"), "e": ("moved", "a"), "f": ("added", None)}


# --- features --------------------------------------------------------------------------------------


def test_pretty_printed_collection(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"a": 1, "b": None}},
        {"type": "Feature", "geometry": None, "properties": {"a": "x"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {}},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    got = ft.feature_row_id(landed.geojson_scan(spark, str(tmp_path / "c.json"), multiline=True)).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2]
    assert json.loads(got[0].geometry.coordinates) == [1.5, 2] and {k: v.toPython() for k, v in got[0].properties.items()} == {"a": 1, "b": None}
    assert got[1].geometry is None
    assert json.loads(got[2].geometry.coordinates)[0][3] == [0, 0]


def test_one_huge_collection_is_read_by_many_tasks(spark, tmp_path):
    text = lambda i: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, {"a": i}["a"]]},
                                 "properties": {"id": i, "note": "},{[" * (i % 3), "more": {"deep": [i]}}}, separators=(",", ":"))
    body = ",".join(text(i) for i in range(4000))
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","name":"x","crs":{"type":"name"},"features":[' + body + '],"total":4000}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        scan = landed.geojson_split_scan(spark, str(tmp_path / "c.json"))
        assert scan.rdd.getNumPartitions() > 5
        got = {r.pos: r for r in scan.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    whole = landed.geojson_scan(spark, str(tmp_path / "c.json"), multiline=True).collect()
    assert len(got) == len(whole) == 4000
    assert all(got[r.pos].geometry == r.geometry and {k: str(v) for k, v in got[r.pos].properties.items()} == {k: str(v) for k, v in r.properties.items()} for r in whole)


def test_error_page_fails_the_read(spark, tmp_path):
    page = {"layer_id": 0, "layer_name": "a", "page_no": 0, "status": 200, "body": json.dumps({"error": {"code": 400}})}
    (tmp_path / "p.json").write_text(json.dumps(page))
    with pytest.raises(Exception, match="service error"):
        landed.geojson_page_scan(spark, str(tmp_path)).collect()


def test_empty_service_fails(spark):
    services = spark.createDataFrame([("s", [])], "service STRING, layers ARRAY<STRUCT<id: INT, name: STRING>>")
    info = spark.createDataFrame([], "service STRING, id INT, supportsPagination BOOLEAN, maxRecordCount INT")
    with pytest.raises(Exception, match="no layers"):
        ft.layer_catalog(services, info).collect()


def test_page_plan_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ft, "PLAN_BLOCK", 4)
    layers = spark.createDataFrame([(1, 0, 10), (2, 1, 10), (3, 100, 10), (4, 101, 10)], "id INT, total BIGINT, n INT")
    planned = ft.page_plan(layers, F.col("total"), F.col("n")).collect()
    got = {}
    for r in planned:
        got.setdefault(r.id, []).append((r.page_no, r.result_offset))
    assert {k: sorted(v) for k, v in got.items()} == {
        2: [(0, 0)], 3: [(i, i * 10) for i in range(10)], 4: [(i, i * 10) for i in range(11)]}


def test_multipart_lines(spark):
    schema = "layer_name STRING, attributes STRING, geometry STRUCT<rings: ARRAY<ARRAY<ARRAY<DOUBLE>>>, paths: ARRAY<ARRAY<ARRAY<DOUBLE>>>, x: DOUBLE, y: DOUBLE>"
    two = (None, [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 6.0]]], None, None)
    df = spark.createDataFrame([("roads", '{"_source_layer": "mine", "a": "b"}', two), ("pts", None, (None, None, 1.0, 2.0))], schema).withColumn(
        "attributes", F.from_json("attributes", "MAP<STRING, VARIANT>"))
    got = ft.esri_to_geojson(df).orderBy("layer_name").collect()
    assert [json.loads(r.geometry.coordinates) for r in got] == [[1.0, 2.0], [[0.0, 0.0], [1.0, 1.0]]]
    text = lambda r: {k: v.toPython() for k, v in r.properties.items()}
    assert text(got[1]) == {"_source_layer": "roads", "a": "b"} and text(got[0]) == {"_source_layer": "pts"}
    assert ft.esri_to_geojson(df, multipart=True).where("layer_name = 'roads'").count() == 2
    assert ft.esri_to_geojson(df, multipart=True).where("layer_name = 'pts'").count() == 1


def test_feature_text_is_json(spark):
    schema = "id BIGINT, geometry STRUCT<type: STRING, coordinates: STRING>, properties MAP<STRING, STRING>"
    df = spark.createDataFrame([(1, ("Point", "[1,2]"), {'q"': 'a\n"b"'}), (2, None, None)], schema)
    got = [json.loads(r[0]) for r in df.orderBy("id").select(ft.feature_to_json(df)).collect()]
    assert got[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {'q"': 'a\n"b"'}}
    assert got[1] == {"type": "Feature", "geometry": None, "properties": {}}


def test_geojson_sink_summary_and_parallel_files(spark, sf, tmp_path):
    features = stored_features(spark, sf).repartition(4)
    summary = sinks.geojson_sink(features, str(tmp_path / "zoning"), "Zoning", "http://x").first()
    assert (summary.filename, summary.feature_count) == ("zoning", features.count())
    assert sum(f.endswith(".txt") for f in os.listdir(tmp_path / "zoning")) > 1


def test_truthy_property(spark):
    texts = [json.dumps({"p": v}) for v in ("x", "", None, "0", " ", 0, 0.0, 2, False, True, [], [1], {}, {"a": 0})] + ["{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(F.from_json("t", "MAP<STRING, VARIANT>").alias("properties"))
    assert [r.properties["p"].toPython() for r in ft.non_empty_property(df, "p").collect()] == ["x", "0", " ", 2, True, [1], {"a": 0}]


# --- files and pushdown ----------------------------------------------------------------------------


def test_metadata_scan_reads_no_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pdf").write_bytes(b"y" * 5)
    (tmp_path / "c.txt").write_bytes(b"z")
    listed = landed.object_metadata(spark, str(tmp_path), "*.pdf")
    assert "content" not in plan(listed).split("ReadSchema")[1]
    size = cat.corpus_size(listed).first()
    assert (size.total_bytes, size.n_files) == (15, 2)


def test_parts_of_a_corpus_file(spark, tmp_path):
    """Files written in parts by many tasks count once each, with all their bytes."""
    rows = spark.range(90, numPartitions=6).selectExpr("IF(id % 3 = 0, 'de', 'en') AS lang", "CONCAT('x', id) AS text")
    rows.write.partitionBy("lang").text(str(tmp_path / "t"))
    listed = landed.object_metadata(spark, str(tmp_path / "t"), "*.txt")
    assert listed.count() > 2
    size = cat.corpus_size(listed, F.regexp_extract("path", "/lang=([^/]*)/", 1)).first()
    assert (size.total_bytes, size.n_files) == (10 * 3 + 80 * 4, 2)


def test_label_lookup_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "pdf_hash STRING, top_left_lng DOUBLE").write.parquet(str(tmp_path / "l"))
    one = landed.labels_scan(spark, str(tmp_path / "l"), "b")
    assert "PushedFilters: [IsNotNull(pdf_hash), EqualTo(pdf_hash,b)]" in plan(one)
    assert one.count() == 1


def test_url_list(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# list\nhttps://a/1.pdf\n\n https://a/1.pdf \nhttps://a/2.pdf\n")
    assert sorted(r.url for r in landed.url_list_scan(spark, str(tmp_path / "u.txt")).collect()) == ["https://a/1.pdf", "https://a/2.pdf"]


# --- zones -----------------------------------------------------------------------------------------


def test_zone_dimension_is_broadcast_by_its_size(spark, sf):
    from plotweave.fixtures import frame

    joined = zones.zone_lookup(frame(spark, sf, "features"), zones.zone_dim(spark))
    assert "BroadcastHashJoin" in plan(joined)
    assert zones.zone_dim(spark).count() == 15 and zones.renderer_classes(spark).count() == 30


@pytest.mark.parametrize("given, expected", [
    ("UC1: Urban Center 1", "UC1"), ("lower: x", "lower: x"), ("", ""), (None, ""), ("MI: Major UC2: Urban Center 2", "MI"), ("A B: x", "A B: x")])
def test_zone_code(spark, given, expected):
    df = spark.createDataFrame([(given,)], "z STRING")
    assert df.select(zones.zone_code(F.col("z"))).first()[0] == expected


@pytest.mark.parametrize("expression", [
    "ZONEDESC = 'a'; DROP TABLE x", "other = 1", "ZONEDESC = java_method('java.lang.System', 'exit')", "ZONEDESC = 'a\\' OR 1=1",
    "ZONEDESC = (SELECT 1)", "ZONEDESC = `x`"])
def test_layer_filter_rejects_what_it_does_not_know(spark, expression):
    df = spark.createDataFrame([("a",)], "ZONEDESC STRING")
    with pytest.raises(ValueError):
        zones.layer_definition_filter(df, expression, ["ZONEDESC"])


def test_layer_filter_drops_nulls(spark):
    df = spark.createDataFrame([("Historical District",), ("Commercial",), (None,), ("Residential Rental Short Term",)], "ZONEDESC STRING")
    kept = lambda text: [r[0] for r in zones.layer_definition_filter(df, text, ["ZONEDESC"]).collect()]
    assert kept(zones.ZONING_FILTER) == ["Commercial"]
    assert kept(zones.RENTAL_FILTER) == ["Residential Rental Short Term"]


# --- pages -----------------------------------------------------------------------------------------


def test_headings(spark):
    html = """<html><h1 class="a">One <b>bold</b></h1><!-- <h2>no</h2> --><script>"<h2>no</h2>"</script>
        <h2>  </h2><H3>Three &amp; more</H3><h5>no</h5><h4>\n Four x </h4><header>no</header>"""
    df = spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")
    got = [(r.pos, r.level, r.text) for r in disc.html_headings(df).orderBy("pos").collect()]
    assert got == [(0, 1, "One bold"), (1, 3, "Three & more"), (2, 4, "Four x")]


def test_headings_left_open(spark):
    """What is open ends with the element around it; with nested=False with the next heading."""
    pages = spark.createDataFrame([(1, "<div><h1>a<h2>b</div>c<h3>d"), (2, None), (3, ""), (4, "no tags"), (4, "<h1>x</h1>")], "page_id INT, html STRING")
    read = lambda nested: sorted(tuple(r) for r in disc.html_headings(pages, nested).collect())
    assert read(True) == [(1, 0, 1, "ab"), (1, 1, 2, "b"), (1, 2, 3, "d"), (4, 0, 1, "x")]
    assert read(False) == [(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 3, "d"), (4, 0, 1, "x")]
    assert disc.html_headings(pages.limit(0)).count() == 0


class Tree(HTMLParser):
    """The whole tree, and the wanted elements' texts read from it: an independent, quadratic version."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ["", None, []]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("href"), []]
        self.path[-1][2].append(node)
        if tag not in markup.VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][2].append([tag, dict(attrs).get("href"), []])

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)

    def text(self, node):
        inside = (c if isinstance(c, str) else "" if c[0] in markup.HIDDEN else self.text(c) for c in node[2])
        return "".join(inside)

    def wanted(self, names, node=None):
        for child in (node or self.root)[2]:
            if not isinstance(child, str):
                if child[0] in names:
                    yield child[0], child[1], self.text(child)
                yield from self.wanted(names, child)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "<h1>", "</h1>", "<h2 class='a>b'>", "</h2>", "<div>", "</div>", "<b>", "</b>", "<a href=\"x y\">", "<a href=z>", "</a>", "<br>", "<br/>", "<h1/>",
    "<!-- <h1>no</h1> -->", "<!doctype html>", "<script>'</div><h1>'</script>", "one ", "two", " 3 > 2 ", "</p>", "<A HREF='u'>"]), max_size=30))
def test_elements_equal_those_of_a_whole_tree(parts):
    """Text directly within a hidden element is hidden there only as part of others; none of the wanted are hidden."""
    page, tree = "".join(parts), Tree()
    tree.feed(page)
    tree.close()
    names = ("h1", "h2", "a")
    assert markup.elements(page, names, "href") == list(tree.wanted(names))


@pytest.mark.parametrize("page", [
    "<h1>x" * 100_000, "<a href=\"" * 100_000, "<b>" * 200_000 + "</i>" * 200_000, "<!--" * 200_000, "< " * 300_000, "<script>" * 100_000,
    "<a b='" * 100_000 + "c=\"" * 100_000, "</" * 200_000, "<h1" + " " * 500_000, "<x/" * 200_000])
def test_a_broken_page_is_read_in_linear_time(page):
    started = time.monotonic()
    assert sum(len(text) for _, _, text in markup.elements(page, ("h1", "a"), nested=False)) <= len(page)
    assert time.monotonic() - started < 10


def test_links(spark):
    html = "<a name='x'>no</a><a class=b href='/al/town/codes'>Town</a><abbr href='/no'>no</abbr><A HREF=\"/x\"> </A>"
    df = spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")
    links = disc.page_links(df)
    assert [(r.href, r.text) for r in links.orderBy("pos").collect()] == [("/al/town/codes", "Town"), ("/x", "")]
    assert disc.link_has_text(links).count() == 1
    soup = spark.createDataFrame([(1, "<a href=/u?x=1&amp;y=2>un<b>quoted</a> <p><a href='/open'>open</p> <a href>bare</a>", 7)], "page_id BIGINT, html STRING, site INT")
    assert [tuple(r) for r in disc.page_links(soup, "site").orderBy("pos").collect()] == [
        (1, 7, 0, "/u?x=1&y=2", "unquoted"), (1, 7, 1, "/open", "open"), (1, 7, 2, "", "bare")]


def test_first_link_wins_even_when_the_slug_is_dropped(spark):
    links = spark.createDataFrame([
        ("al", 0, "https://c.org/al/town/codes", "Town"), ("al", 1, "https://c.org/al/town", "Again"), ("al", 2, "https://c.org/al/codes/x", "no"),
        ("al", 3, "https://c.org/ga/city/x", "other state"), ("al", 4, "https://c.org/al", "too short"), ("al", 5, "https://c.org/al/ville/", "  "),
    ], "state STRING, pos INT, href STRING, text STRING")
    got = disc.municipalities(links, "https://c.org").collect()
    assert [(r.slug, r.name, r.url) for r in got] == [("town", "Town", "https://c.org/al/town")]


def test_toc(spark):
    doc = json.dumps({"root_heading": " T1 ", "root_id": "r1", "children": [{"heading": "a", "node_id": "n1"}, {"heading": "b", "node_id": "n2"}]})
    alone = json.dumps({"root_heading": "T2", "root_id": "r2", "children": []})
    missing = json.dumps({"root_heading": "T3", "root_id": "r3"})
    got = disc.toc_flatten(disc.parse_toc(lines(spark, doc, alone, missing))).collect()
    assert [(r.path, r.parent_node_id, r.node_id) for r in got] == [
        (["T1", "a"], "r1", "n1"), (["T1", "b"], "r1", "n2"), (["T2"], None, "r2"), (["T3"], None, "r3")]


# --- live format -----------------------------------------------------------------------------------


def service(spark, fetcher="fetch"):
    feature_service.register(spark)
    return spark.read.format("feature_service").option("url", "https://services.example.com/FeatureServer").option(
        "fetcher", f"tests.service_stub:{fetcher}").load()


def test_feature_service_fetches_every_row_once(spark):
    from tests import service_stub

    pages = service(spark)
    got = ft.page_features(pages).select("layer_id", F.col("attributes")["OBJECTID"].cast("int").alias("n"), F.col("geometry.x").alias("x"))
    assert sorted((r.layer_id, r.n) for r in got.collect()) == sorted((k, n) for k, v in service_stub.ROWS.items() for n in range(v))
    sizes = {(r.layer_id, r.page_no) for r in pages.collect()}
    assert sizes == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)}


def test_feature_service_asks_only_for_the_filtered_layer(spark):
    got = service(spark, "fetch_only_layer_one").where("layer_id = 1")
    assert {r.page_no for r in got.collect()} == {0, 1, 2}


def test_failing_layers_become_error_pages(spark):
    pages = service(spark, "fetch_broken").collect()
    assert {(r.layer_id, r.status) for r in pages if r.layer_id != 1} == {(0, 200), (2, 500)}
    assert sum(len(json.loads(r.body)["features"]) for r in pages if r.layer_id == 1) == 23
    assert "no counts" in next(r.body for r in pages if r.layer_id == 0)


def test_rows_added_after_planning_are_read(spark):
    pages = [r for r in service(spark, "fetch_growing").collect() if r.layer_id == 0]
    assert sorted(r.page_no for r in pages) == [0, 1, 2] and sum(len(json.loads(r.body)["features"]) for r in pages) == 25


def test_landed_and_live_pages_agree(spark, tmp_path):
    pages = service(spark)
    pages.write.json(str(tmp_path / "pages"))
    again = landed.feature_page_scan(spark, str(tmp_path / "pages"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pages.collect()))


def test_manifest_parts_are_numbered_by_path(spark, tmp_path):
    """Part files of a Spark job end in the same digits; their order is that of their names, numbers as numbers."""
    for name, md5 in (("part-00002-x-c000.json", "c"), ("part-00000-x-c000.json", "a"), ("part-00001-x-c000.json", "b"), ("part-10-x.json", "d")):
        (tmp_path / name).write_text(json.dumps([{"md5": md5, "relpath": "p"}]))
    read = landed.manifest_scan(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.md5 for r in read] == ["a", "b", "c", "d"] and len({r.ord for r in read}) == 4


COLLECTION = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2.5]}, "properties": {"id": i, "deep": {"a": [i]}}} for i in range(20)]}


@pytest.mark.parametrize("layout", [{}, {"separators": (",", ":")}, {"indent": 2}])
def test_collections_in_any_layout(spark, tmp_path, layout):
    (tmp_path / "c.json").write_text(json.dumps(COLLECTION, **layout))
    split = landed.geojson_split_scan(spark, str(tmp_path)).collect()
    whole = landed.geojson_scan(spark, str(tmp_path), multiline=True).collect()
    assert sorted(r.properties["id"].toPython() for r in split) == sorted(r.properties["id"].toPython() for r in whole) == list(range(20))
    assert {json.loads(r.geometry.coordinates)[0] for r in split} == set(range(20))


def test_other_key_order_is_read_whole_or_fails(spark, tmp_path):
    turned = {"features": [dict(reversed(f.items())) for f in COLLECTION["features"]], "type": "FeatureCollection"}
    (tmp_path / "c.json").write_text(json.dumps(turned))
    assert landed.geojson_scan(spark, str(tmp_path)).count() == 20
    with pytest.raises(Exception, match="type first"):
        landed.geojson_split_scan(spark, str(tmp_path)).collect()


def test_nothing_is_dropped_in_silence(spark, tmp_path):
    text = json.dumps(COLLECTION)
    for name, body in (("indented", json.dumps(COLLECTION, indent=1)), ("short", text[:-150]), ("html", "<html>no</html>"), ("other", "{}")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "c.json").write_text(body)
        with pytest.raises(Exception, match="not a collection"):
            landed.geojson_scan(spark, str(folder)).collect()
        assert landed.collection_rejects(landed.collection_texts(spark, str(folder))).count() > 0
        if name != "indented":
            with pytest.raises(Exception, match="type first"):
                landed.geojson_split_scan(spark, str(folder)).collect()
    (tmp_path / "empty.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert landed.geojson_split_scan(spark, str(tmp_path / "empty.json")).count() == 0
    assert landed.geojson_scan(spark, str(tmp_path / "empty.json")).count() == 0


def test_bad_pages_fail_or_are_listed(spark, tmp_path):
    page = lambda n, status, body: json.dumps({"layer_id": 0, "layer_name": "a", "page_no": n, "status": status, "body": body})
    pages = [page(0, 200, json.dumps(COLLECTION)), page(1, 500, "<html>"), page(2, 200, ""), page(3, 200, "<html>"), page(4, 200, '{"error":{"code":1}}')]
    (tmp_path / "p.json").write_text("\n".join(pages))
    with pytest.raises(Exception, match="unusable"):
        landed.geojson_page_scan(spark, str(tmp_path)).collect()
    rejects = {r.page_no: r.reason for r in landed.geojson_page_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {1: "status 500", 2: "blank", 3: "no JSON", 4: 'service error: {"code":1}'}

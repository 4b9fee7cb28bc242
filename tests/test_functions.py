"""Column functions against literals."""

import math

import pytest
from pyspark.sql import functions as F

from plotweave.functions import geometry as geo
from plotweave.functions import paths, text, urls
from plotweave.operators import discovery as disc


def value(spark, expression, **columns):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in columns.items()) or "x INT"
    row = tuple(v for _, v in columns.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]


def of_text(spark, function, given):
    return value(spark, function(F.col("t")), t=("STRING", given))


@pytest.mark.parametrize("given, expected", [
    ("  A\t b\n\nC ", "a b c"), (None, ""), (" x  y　", "x y"), ("\x1cA\x1fB", "a b"), ("ÉT É", "ét é"),
])
def test_norm_text(spark, given, expected):
    assert of_text(spark, text.norm_text, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("a\x00b\x07c\x7f", "abc"), ("a\n\n\n\nb", "a\n\nb"), ("a   b", "a b"), ("  a\tb\r\n ", "a\tb"),
    ("a\n\x0b\n\nb", "a\n\nb"),  # control characters go first, then blank lines collapse
    ("a \x01 b", "a b"),
])
def test_clean_text(spark, given, expected):
    assert of_text(spark, text.clean_text, given) == expected


@pytest.mark.parametrize("given, expected", [("Café: Zoning/2024 - a_b!", "Café_Zoning2024_-_a_b"), (" x ", "x"), ("a\tb", "a\tb")])
def test_safe_title(spark, given, expected):
    assert of_text(spark, text.safe_title, given) == expected


def test_slugify(spark):
    assert of_text(spark, text.slugify, "Salt Lake  City") == "salt-lake--city"


def test_format_count(spark):
    assert value(spark, text.format_count(F.col("n")), n=("BIGINT", 1234567)) == "1,234,567"


def test_content_key(spark):
    assert of_text(spark, paths.content_addressed_layout, "0123abcd") == "files/md5/01/23abcd"
    assert of_text(spark, lambda c: paths.content_addressed_layout(c, ".dir"), "0123abcd") == "files/md5/01/23abcd.dir"


def test_relative_layout(spark):
    move = lambda c: paths.relative_layout(c, "out", "remote/x/")
    assert of_text(spark, move, "out\\a\\b.txt") == "remote/x/a/b.txt"
    assert of_text(spark, move, "outer/a.txt") == "remote/x/outer/a.txt"


@pytest.mark.parametrize("given, expected", [("a/b/map.v2.pdf", "map.v2"), ("x", "x"), (".hidden", ".hidden")])
def test_file_stem(spark, given, expected):
    assert of_text(spark, paths.file_stem, given) == expected


def test_page_name(spark):
    assert value(spark, paths.page_name(F.lit("doc"), F.lit(7))) == "doc_page_007"
    assert value(spark, paths.page_name(F.lit("doc"), F.lit(1234))) == "doc_page_1234"


def test_section_names_round_trip(spark):
    name = value(spark, paths.section_file_name(F.col("p")), p=("ARRAY<STRING>", ["Title 1", "A/B\\C"]))
    assert name == "Title 1⫸A-B-C.docx"
    parts = of_text(spark, paths.section_title_parts, name)
    assert (parts.document_title, parts.document_subtitle) == ("Title 1", "A-B-C")
    alone = of_text(spark, paths.section_title_parts, "Title 1.docx")
    assert (alone.document_title, alone.document_subtitle) == ("Title 1", None)


def test_content_matches(spark):
    md5 = "d41d8cd98f00b204e9800998ecf8427e"
    check = lambda b64: value(spark, paths.content_matches(F.lit(md5), F.col("b")), b=("STRING", b64))
    assert check("1B2M2Y8AsgTpgAmY7PhCfg==") is True
    assert check("") is False
    assert check(None) is False
    assert check("AAAAAAAAAAAAAAAAAAAAAA==") is False


def test_coordinate_label(spark):
    assert value(spark, paths.coordinate_label(F.lit(33.6598), F.lit(-85.8316))) == "33.6598°N, 85.8316°W"


@pytest.mark.parametrize("given, expected", [
    ("https://maps.example.com/v?layers=abc", "abc"),
    ("https://maps.example.com/v?id=abc&layers=xyz", "xyz"),
    ("https://maps.example.com/v?layers=&id=a%20b", "a b"),
    ("https://maps.example.com/items/" + "0f" * 16, "0f" * 16),
    ("https://maps.example.com/v#layers=" + "0f" * 16, "0f" * 16),
    ("https://maps.example.com/items/short", None),
])
def test_url_layer_id(spark, given, expected):
    assert of_text(spark, urls.url_layer_id, given) == expected


def test_url_layer_id_strict(spark):
    with pytest.raises(Exception, match="no layer id"):
        of_text(spark, lambda c: urls.url_layer_id(c, strict=True), "https://maps.example.com/x")


def test_url_domain_keeps_port(spark):
    assert of_text(spark, urls.url_domain, "https://maps.example.com:8443/a?b#c") == "maps.example.com:8443"


@pytest.mark.parametrize("given", ["https://s/F", "https://s/F/", "https://s/F/0"])
def test_service_layer_url(spark, given):
    assert of_text(spark, urls.service_layer_url, given) == "https://s/F/0"


def test_ordinance_link(spark):
    assert of_text(spark, lambda c: urls.ordinance_link(c, "https://x/"), "Sec 1 & 2/é") == "https://x/Sec%201%20%26%202%2F%C3%A9"


def test_url_path_parts(spark):
    parts = lambda u: of_text(spark, lambda c: urls.url_path_parts(c, "https://x.org"), u)
    assert parts("https://x.org/al/town/codes/") == ["al", "town", "codes"]
    assert parts("https://x.org/") == [""]


# --- geometry --------------------------------------------------------------------------------------

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


@pytest.mark.parametrize("x, y, expected", [
    (5, 5, True), (0, 5, True), (10, 5, False), (5, 0, True), (5, 10, False), (0, 0, True), (10, 10, False), (0, 10, False), (-1, 5, False),
])
def test_inside_edges_half_open(spark, x, y, expected):
    """Left and bottom edges belong to the polygon, right and top ones do not."""
    inside = geo.inside_edges(geo.polygon_edges(F.col("rings")), F.lit(float(x)), F.lit(float(y)))
    assert value(spark, inside, rings=("ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>", [SQUARE])) is expected


def test_signed_area(spark):
    area = geo.ring_signed_area(F.col("r"))
    assert value(spark, area, r=("ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", SQUARE)) == 100.0
    assert value(spark, area, r=("ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", SQUARE[::-1])) == -100.0


def test_in_rect_includes_edges(spark):
    rect = [F.lit(v) for v in (1.0, 1.0, 4.0, 2.0)]
    assert value(spark, geo.in_rect(F.lit(5.0), F.lit(3.0), *rect)) is True
    assert value(spark, geo.in_rect(F.lit(5.01), F.lit(3.0), *rect)) is False


def test_mercator_of_known_points(spark):
    at = value(spark, geo.project_mercator(F.lit(0.0), F.lit(0.0), 1, (0.0, 0.0), (100, 50)))
    assert (at.x, at.y) == (50, 25)
    edge = value(spark, geo.project_mercator(F.lit(180.0), F.lit(85.0511287798066), 0, (0.0, 0.0)))
    assert edge.x == pytest.approx(256) and edge.y == pytest.approx(-256)


@pytest.mark.parametrize("lng, lat", [(-85.83, 33.66), (179.9, -80.0), (0.0, 0.0)])
def test_mercator_round_trip(spark, lng, lat):
    view = {"zoom": 12.5, "center": (-85.0, 33.0), "viewport": (800, 600)}
    at = geo.project_mercator(F.lit(lng), F.lit(lat), **view)
    back = value(spark, geo.unproject_mercator(at.x, at.y, **view))
    assert math.isclose(back.lng, lng, abs_tol=1e-9) and math.isclose(back.lat, lat, abs_tol=1e-9)


@pytest.mark.parametrize("lng, lat, expected", [(-180.0, 85.06, (2, 0, 0)), (179.999, -85.06, (2, 3, 3)), (180.0, 0.0, (2, 3, 2)), (0.0, 0.0, (2, 2, 2))])
def test_tile_key(spark, lng, lat, expected):
    assert tuple(value(spark, geo.tile_key(F.lit(lng), F.lit(lat), 2))) == expected


def test_bbox_reorder(spark):
    assert value(spark, geo.bbox_reorder(F.col("b")), b=("ARRAY<DOUBLE>", [1.0, 2.0, 3.0, 4.0])) == [[3.0, 1.0], [4.0, 2.0]]


def test_character_references_are_resolved_once(spark):
    texts = [("a&#x27;b&#8212;c&copy;d", "a'b\u2014c\u00a9d"), ("&amp;lt;", "&lt;"), ("&nosuch; & &#1114112; &#xD800;", "&nosuch; & &#1114112; &#xD800;"), ("", ""), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t STRING")
    assert [r[0] for r in df.select(disc.resolve_references(F.col("t"))).collect()] == [want for _, want in texts]


def test_tiles_of_poles_and_nulls(spark):
    df = spark.createDataFrame([(0.0, -90.0), (0.0, 90.0), (0.0, None), (None, 1.0)], "lng DOUBLE, lat DOUBLE")
    got = [(r.k.x, r.k.y) for r in df.select(geo.tile_key(F.col("lng"), F.col("lat"), 3).alias("k")).collect()]
    assert got[0] == (4, 7) and got[1] == (4, 0) and got[2] == (4, None) and got[3][0] is None

"""Test inputs derived from the given tables.

Each fixture is a query both Spark and the checking engine can run, so the two sides of a comparison
start from the same rows. Table names stand in braces; a fixture may build on another one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators.zones import RENDERER_CLASSES, ZONES
from plotweave.plans.ordered import number_segment, ordered_row_number
from plotweave.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_zone_values = ", ".join(
    "({}, '{}', '{}', '{}', '{}', '{}')".format(i, *zone) for i, zone in enumerate(ZONES)
)
_class_values = ", ".join(
    f"({i}, '{v}', '{label}', '{'/'.join(map(str, color))}')" for i, (v, label, color) in enumerate(RENDERER_CLASSES)
)

# Shapes of 100 x 100 parcels: shape, ring, vertex, dx, dy.
_SHAPES = {
    "rect": [[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]],
    "ell": [[(0, 0), (100, 0), (100, 50), (50, 50), (50, 100), (0, 100), (0, 0)]],
    "holed": [[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [(25, 25), (75, 25), (75, 75), (25, 75), (25, 25)]],
    "open": [[(0, 0), (100, 0), (100, 100), (0, 100)]],
    "three": [[(0, 0), (100, 0), (0, 0)]],
    "repeated": [[(0, 0), (100, 0), (100, 0), (100, 100), (0, 100), (0, 0)]],
    "bowtie": [[(0, 0), (100, 100), (100, 0), (0, 80), (0, 0)]],
    "flat": [[(0, 0), (100, 0), (50, 0), (0, 0)]],
    "leaving": [[(0, 0), (60, 0), (60, 60), (0, 60), (0, 0)], [(40, 20), (80, 20), (80, 40), (40, 40), (40, 20)]],
    "overlapping": [[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [(10, 10), (50, 10), (50, 50), (10, 50), (10, 10)],
                    [(30, 30), (70, 30), (70, 70), (30, 70), (30, 30)]],
    "nested": [[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [(10, 10), (90, 10), (90, 90), (10, 90), (10, 10)],
               [(30, 30), (70, 30), (70, 70), (30, 70), (30, 30)]],
    "touching": [[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [(0, 50), (20, 30), (40, 50), (20, 70), (0, 50)]],
    # Rings too long for the pairwise test: stairs up and down, and the same with two steps exchanged.
    "stairs": [[(0, 0), (100, 0), *[(100 - 10 * i // 2, 50 + 5 * ((i + 1) // 2)) for i in range(20)], (0, 100), (0, 0)]],
    "tangled": [[(0, 0), (100, 0), *[(100 - 10 * i // 2, 50 + 5 * ((i + 1) // 2)) for i in (*range(8), 12, 9, 10, 11, 8, *range(13, 20))], (0, 100), (0, 0)]],
    "island": [[(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], [(60, 60), (90, 60), (90, 90), (60, 90), (60, 60)]],
}
_shape_values = ", ".join(
    f"('{shape}', {ring_no}, {vertex_no}, {x}, {y})"
    for shape, rings in _SHAPES.items()
    for ring_no, ring in enumerate(rings)
    for vertex_no, (x, y) in enumerate(ring)
)

# Rings of features: shape, ring, polygon it belongs to, 1 for a hole, and the corners of its square.
_NESTS = {
    "plain": [(0, 0, (0, 0, 90, 90))],
    "lake": [(0, 0, (0, 0, 90, 90)), (0, 1, (20, 20, 70, 70))],
    "islands": [(0, 0, (0, 0, 40, 40)), (1, 0, (50, 50, 90, 90))],
    "island in lake": [(0, 1, (10, 10, 80, 80)), (0, 0, (0, 0, 90, 90)), (1, 0, (30, 30, 60, 60))],
    "deep": [(0, 0, (0, 0, 90, 90)), (0, 1, (5, 5, 85, 85)), (1, 0, (10, 10, 80, 80)), (1, 1, (20, 20, 40, 40)), (1, 1, (50, 50, 70, 70)), (2, 0, (55, 55, 65, 65))],
}
_nest_values = ", ".join(
    f"('{shape}', {ring_no}, {part}, {hole}, {vertex_no}, {corners[x]}, {corners[y]})"
    for shape, rings in _NESTS.items()
    for ring_no, (part, hole, corners) in enumerate(rings)
    for vertex_no, (x, y) in enumerate([(0, 1), (2, 1), (2, 3), (0, 3), (0, 1)])
)

FIXTURES: dict[str, str] = {
    # Manifest: content hashes and paths; some paths repeat with another hash further down.
    "manifest": """
        SELECT md5(text) AS md5,
               (CASE WHEN doc_id % 13 = 0 THEN 'archive/' ELSE 'maps/' END) || upper(lang) || '/' || source || '/' ||
               (CASE WHEN doc_id % 7 = 0 THEN 'geojson/' || CAST(doc_id AS STRING) || '.json'
                     WHEN doc_id % 11 = 0 THEN 'pdf/' || CAST(doc_id AS STRING) || '.PDF'
                     ELSE 'pdf/' || CAST(doc_id AS STRING) || '.pdf' END) AS relpath,
               doc_id AS ord, doc_id, n_chars
        FROM {documents}
        UNION ALL
        SELECT md5('copy' || text),
               'maps/' || upper(lang) || '/' || source || '/pdf/' || CAST(doc_id AS STRING) || '.pdf',
               doc_id + 1000000000, doc_id, n_chars
        FROM {documents} WHERE doc_id % 31 = 1""",
    # A later version: some entries dropped, some moved, some with new content, some new.
    "manifest_next": """
        SELECT CASE WHEN doc_id % 23 = 0 THEN md5('new' || md5) ELSE md5 END AS md5,
               CASE WHEN doc_id % 19 = 0 THEN 'maps/moved/' || CAST(ord AS STRING) || '.pdf' ELSE relpath END AS relpath,
               ord
        FROM {manifest} AS m WHERE doc_id % 17 <> 0
        UNION ALL
        SELECT md5('added' || CAST(doc_id AS STRING)), 'maps/added/' || CAST(doc_id AS STRING) || '.pdf', doc_id + 2000000000
        FROM {documents} WHERE doc_id % 29 = 0""",
    "catalog": """
        SELECT md5 AS hash, substr(relpath, 6) AS path, split_part(relpath, '/', 5) AS name,
               split_part(relpath, '/', 2) AS state, split_part(relpath, '/', 3) AS city, ord, n_chars
        FROM {manifest} AS m WHERE relpath LIKE 'maps/%' AND relpath LIKE '%.pdf'""",
    # Paths that are asked for: known, unknown, not all of an accepted type.
    "requests": """
        SELECT doc_id AS request_id,
               upper(lang) || '/' || source || '/' ||
               (CASE WHEN doc_id % 7 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 'geojson/' ELSE '' END) || CAST(doc_id AS STRING) || '.json'
                     WHEN doc_id % 5 = 0 THEN 'pdf/missing' || CAST(doc_id AS STRING) || '.pdf'
                     WHEN doc_id % 9 = 0 THEN 'pdf/' || CAST(doc_id AS STRING) || '.docx'
                     ELSE 'pdf/' || CAST(doc_id AS STRING) || '.pdf' END) AS path
        FROM {documents}""",
    # Georeference labels of every third document, one per content, plus some of unknown contents.
    "geolabels": """
        SELECT pdf_hash, 'maps/' || pdf_hash || '.pdf' AS pdf_path,
               -85.9e0 + s AS top_left_lng, 33.75e0 + s / 2 AS top_left_lat,
               -85.8e0 + s AS top_right_lng, 33.75e0 + s / 4 AS top_right_lat,
               -85.8e0 + s AS bottom_right_lng, 33.65e0 + s / 4 AS bottom_right_lat,
               -85.9e0 + s AS bottom_left_lng, 33.65e0 + s / 2 AS bottom_left_lat,
               1704067200 + d * 60 AS created_s, 1704067200 + d * 60 + (d % 7) * 3600 AS updated_s, d
        FROM (SELECT md5(text) AS pdf_hash, min(doc_id) AS d, CAST(min(doc_id) % 100 AS DOUBLE) / 1000e0 AS s
              FROM {documents} WHERE doc_id % 3 = 0 GROUP BY md5(text)
              UNION ALL
              SELECT md5('orphan' || CAST(r_regionkey AS STRING)), CAST(r_regionkey AS BIGINT), CAST(r_regionkey AS DOUBLE) / 1000e0
              FROM {region}) AS h""",
    # Saves and deletes of labels; several per hash.
    "label_events": """
        SELECT e.event_id, e.ts, CASE WHEN e.event_type = 'error' THEN 'delete' ELSE 'save' END AS op,
               md5(d.text) AS pdf_hash, 'maps/event/' || CAST(e.event_id AS STRING) || '.pdf' AS pdf_path,
               -85.9e0 + e.value / 1000e0 AS top_left_lng, 33.75e0 AS top_left_lat,
               -85.8e0 + e.value / 1000e0 AS top_right_lng, 33.75e0 AS top_right_lat,
               -85.8e0 + e.value / 1000e0 AS bottom_right_lng, 33.65e0 AS bottom_right_lat,
               -85.9e0 + e.value / 1000e0 AS bottom_left_lng, 33.65e0 AS bottom_left_lat
        FROM {events} AS e JOIN {documents} AS d ON d.doc_id = e.user_id""",
    "zones": f"""
        SELECT i, zone, code, name, color, description
        FROM (VALUES {_zone_values}) AS z(i, zone, code, name, color, description)""",
    "classes": f"""
        SELECT i, value, label, color FROM (VALUES {_class_values}) AS c(i, value, label, color)""",
    # Features with a zone, an address and a sheet number; two of seventeen zone values are unknown.
    "features": """
        SELECT p.p_partkey AS id,
               CASE WHEN p.p_partkey % 17 = 15 THEN 'Overlay' WHEN p.p_partkey % 17 = 16 THEN 'lower: x' ELSE z.zone END AS zone,
               CASE WHEN p.p_partkey % 9 = 0 THEN '   ' WHEN p.p_partkey % 9 = 1 THEN NULL
                    ELSE CAST(p.p_partkey AS STRING) || ' ' || p.p_name END AS street,
               CASE WHEN p.p_partkey % 8 = 0 THEN '' WHEN p.p_partkey % 8 = 1 THEN NULL
                    ELSE 'NW_' || lpad(CAST(p.p_partkey % 300 AS STRING), 3, '0') END AS sheet,
               (p.p_partkey % 50) * 100 AS x0, CAST(floor(p.p_partkey / 50) AS BIGINT) * 100 AS y0
        FROM {part} AS p LEFT JOIN {zones} AS z ON z.i = p.p_partkey % 17""",
    # Zoned features as a web map layer sees them.
    "parcels": """
        SELECT p.p_partkey AS id, CASE WHEN p.p_partkey % 33 >= 30 THEN 'ZZ' ELSE c.value END AS ZONECLASS,
               CASE WHEN p.p_partkey % 6 = 0 THEN 'Residential Rental Short Term' WHEN p.p_partkey % 6 = 1 THEN 'Historical District'
                    WHEN p.p_partkey % 6 = 2 THEN NULL ELSE p.p_type END AS ZONEDESC,
               p.p_retailprice * 7 AS ACRES, p.p_name || ' & ' || p.p_type AS OnlineCode,
               p.p_partkey % 900 AS day_no
        FROM {part} AS p LEFT JOIN {classes} AS c ON c.i = p.p_partkey % 33""",
    # Parcels on a grid of 50 columns, and districts of 1000 x 1000 over them: vertices of rings.
    "vertices": f"""
        SELECT p.poly_id, p.zone_no, p.shape, s.ring_no, s.vertex_no,
               CAST(p.x0 + s.dx * p.scale AS DOUBLE) AS x, CAST(p.y0 + s.dy * p.scale AS DOUBLE) AS y
        FROM (SELECT p_partkey AS poly_id, p_partkey % 17 AS zone_no, (p_partkey % 50) * 100 AS x0,
                     CAST(floor(p_partkey / 50) AS BIGINT) * 100 AS y0, 1 AS scale,
                     CASE WHEN p_partkey % 15 = 0 THEN 'holed' WHEN p_partkey % 10 = 0 THEN 'ell' ELSE 'rect' END AS shape
              FROM {{part}}
              UNION ALL
              SELECT 1000000000 + s_suppkey, s_suppkey % 17, (s_suppkey % 5) * 1000, CAST(floor(s_suppkey / 5) AS BIGINT) * 1000, 10, 'ell'
              FROM {{supplier}}) AS p
        JOIN (VALUES {_shape_values}) AS s(shape, ring_no, vertex_no, dx, dy) ON s.shape = p.shape""",
    # The same grid with every kind of fault.
    "faulty_vertices": f"""
        SELECT p.poly_id, p.shape, s.ring_no, s.vertex_no, CAST(p.x0 + s.dx AS DOUBLE) AS x, CAST(p.y0 + s.dy AS DOUBLE) AS y
        FROM (SELECT p_partkey AS poly_id, (p_partkey % 50) * 100 AS x0, CAST(floor(p_partkey / 50) AS BIGINT) * 100 AS y0,
                     CASE p_partkey % 18 WHEN 8 THEN 'leaving' WHEN 9 THEN 'overlapping' WHEN 10 THEN 'nested' WHEN 11 THEN 'touching'
                          WHEN 12 THEN 'stairs' WHEN 13 THEN 'tangled' WHEN 0 THEN 'open' WHEN 1 THEN 'three' WHEN 2 THEN 'repeated' WHEN 3 THEN 'bowtie'
                          WHEN 4 THEN 'flat' WHEN 5 THEN 'island' WHEN 6 THEN 'holed' WHEN 7 THEN 'ell' ELSE 'rect' END AS shape
              FROM {{part}}) AS p
        JOIN (VALUES {_shape_values}) AS s(shape, ring_no, vertex_no, dx, dy) ON s.shape = p.shape""",
    # Features whose rings are islands, lakes and islands in lakes.
    "nested_vertices": f"""
        SELECT p.id, p.shape, s.ring_no, s.part_no, s.hole, s.vertex_no, CAST(p.x0 + s.dx AS DOUBLE) AS x, CAST(p.y0 + s.dy AS DOUBLE) AS y
        FROM (SELECT p_partkey AS id, (p_partkey % 50) * 100 AS x0, CAST(floor(p_partkey / 50) AS BIGINT) * 100 AS y0,
                     CASE p_partkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'lake' WHEN 2 THEN 'islands' WHEN 3 THEN 'island in lake' ELSE 'deep' END AS shape
              FROM {{part}}) AS p
        JOIN (VALUES {_nest_values}) AS s(shape, ring_no, part_no, hole, vertex_no, dx, dy) ON s.shape = p.shape""",
    "points": """
        SELECT c_custkey AS pt_id, CAST((c_custkey * 7919) % 5000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 6000 AS DOUBLE) AS y
        FROM {customer}""",
    # One polygon under all points, two facing combs, with a vertex for every order.
    "comb_vertices": """
        SELECT 1 AS poly_id, 0 AS zone_no, 0 AS ring_no, k AS vertex_no,
               CASE WHEN k < half THEN k * 5000.0 / half ELSE (n - 1 - k) * 5000.0 / (n - half) END AS x,
               CASE WHEN k < half THEN (k % 2) * 2900.0 + (k * 7919) % 100 ELSE 6000.0 - (k % 2) * 2900.0 - (k * 104729) % 100 END AS y
        FROM (SELECT k, n, CAST(floor(n / 2) AS BIGINT) AS half FROM (
              SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM {orders}) AS c) AS h
        UNION ALL SELECT 1, 0, 0, count(*), 0.0, 0.0 FROM {orders}""",
    "many_points": """
        SELECT l_orderkey * 8 + l_linenumber AS pt_id,
               CAST(((l_orderkey * 8 + l_linenumber) * 7919) % 5000 AS DOUBLE) AS x,
               CAST(((l_orderkey * 8 + l_linenumber) * 104729) % 40000 AS DOUBLE) AS y
        FROM {lineitem}""",
    # Frames of map sheets on a large table; slightly skewed quadrilaterals.
    "frames": """
        SELECT p_partkey AS frame_id,
               CAST((p_partkey % 50) * 100 AS DOUBLE) AS top_left_x, CAST(floor(p_partkey / 50) * 100 AS DOUBLE) AS top_left_y,
               CAST((p_partkey % 50) * 100 + 80 AS DOUBLE) AS top_right_x, CAST(floor(p_partkey / 50) * 100 + 5 AS DOUBLE) AS top_right_y,
               CAST((p_partkey % 50) * 100 + 85 AS DOUBLE) AS bottom_right_x, CAST(floor(p_partkey / 50) * 100 + 60 AS DOUBLE) AS bottom_right_y,
               CAST((p_partkey % 50) * 100 + 10 AS DOUBLE) AS bottom_left_x, CAST(floor(p_partkey / 50) * 100 + 15 AS DOUBLE) AS bottom_left_y
        FROM {part}""",
    # Features of a paged service, flat: five layers, every geometry kind and some of none.
    "service_features": """
        SELECT p.p_partkey AS id, CAST(p.p_partkey % 5 AS INT) AS layer_id, r.r_name AS layer_name,
               CAST(floor(p.p_partkey / 5) AS BIGINT) AS n,
               CAST(floor(floor(p.p_partkey / 5) / 20) AS BIGINT) AS page_no,
               CASE p.p_partkey % 7 WHEN 0 THEN 'rings' WHEN 1 THEN 'paths' WHEN 2 THEN 'point' WHEN 3 THEN 'none' WHEN 4 THEN 'curve' ELSE 'rings' END AS kind,
               p.p_name, p.p_size,
               CASE WHEN p.p_partkey % 11 = 0 THEN 'own value' END AS own_tag
        FROM {part} AS p JOIN {region} AS r ON r.r_regionkey = p.p_partkey % 5""",
    "service_pages": """
        SELECT layer_id, layer_name, page_no,
               CASE WHEN layer_id = 3 AND page_no % 3 = 1 THEN 'blank' WHEN layer_id = 4 AND page_no % 4 = 2 THEN 'error' ELSE 'good' END AS outcome,
               count(*) AS n_features
        FROM {service_features} AS f GROUP BY layer_id, layer_name, page_no""",
    # Map viewer URLs in every form.
    "viewer_urls": """
        SELECT p_partkey AS url_id, md5(p_name) AS expected,
               CASE p_partkey % 8
                    WHEN 0 THEN 'https://maps.example.com/apps/viewer/index.html?layers=' || md5(p_name)
                    WHEN 1 THEN 'https://maps.example.com:8443/home/item.html?id=' || md5(p_name)
                    WHEN 2 THEN 'https://maps.example.com/view?id=ffff&layers=' || md5(p_name)
                    WHEN 3 THEN 'https://maps.example.com/sharing/items/' || md5(p_name)
                    WHEN 4 THEN 'https://maps.example.com/view#layers=' || md5(p_name)
                    WHEN 5 THEN 'https://maps.example.com/view?layers=&id=' || md5(p_name)
                    WHEN 6 THEN 'http://u@maps.example.com/none'
                    ELSE 'https://maps.example.com/view#id=' || md5(p_name) END AS url
        FROM {part}""",
    # Two-level tables of contents: suppliers with parts below; every tenth has none.
    "toc": """
        SELECT s.s_suppkey AS root_no, 'Title ' || CAST(s.s_suppkey AS STRING) || ' / A' || chr(92) || 'B' AS root_heading,
               'R' || CAST(s.s_suppkey AS STRING) AS root_id,
               p.p_partkey AS child_no, 'Sec. ' || p.p_name || ' / ' || CAST(p.p_partkey AS STRING) AS heading,
               'N' || CAST(p.p_partkey AS STRING) AS node_id
        FROM {supplier} AS s LEFT JOIN {part} AS p
          ON CAST(floor(p.p_partkey / 20) AS BIGINT) = s.s_suppkey AND s.s_suppkey % 10 <> 0""",
    "ledger": """
        SELECT event_id, user_id AS section_id, ts, CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status
        FROM {events}""",
    "sightings": """
        SELECT event_id, ts AS seen_at, ts AS mtime, CAST(floor(value * 20) AS BIGINT) AS size,
               'downloads/' || (CASE WHEN user_id % 13 = 0 THEN '.' ELSE '' END) || 'file' || CAST(user_id AS STRING) ||
               (CASE event_id % 6 WHEN 0 THEN '.crdownload' WHEN 1 THEN '.tmp' WHEN 2 THEN '.part' WHEN 3 THEN '/' ELSE '.docx' END) AS path
        FROM {events}""",
    # Places: twenty names shared by all, some abroad.
    "gazetteer": """
        SELECT s_suppkey AS place_id, CAST(s_suppkey % 7 AS INT) AS place_rank, 'Place  ' || CAST(s_suppkey % 20 AS STRING) AS name,
               CASE WHEN s_suppkey % 4 = 0 THEN 'ca' ELSE 'us' END AS country,
               CAST(30 + s_suppkey % 15 AS STRING) || '.5' AS lat, CASE WHEN s_suppkey % 9 = 0 THEN 'n/a' ELSE '-' || CAST(80 + s_suppkey % 15 AS STRING) || '.25' END AS lon
        FROM {supplier}""",
    "place_queries": """
        SELECT c_custkey AS query_id,
               CASE WHEN c_custkey % 10 = 0 THEN '  ' WHEN c_custkey % 10 = 1 THEN 'nowhere' ELSE ' PLACE ' || CAST(c_custkey % 25 AS STRING) END AS query
        FROM {customer}""",
    # Places with names of several words, and queries that leave out words or letters, exchange or add them.
    "towns": """
        SELECT p_partkey AS place_id, CAST(p_partkey % 7 AS INT) AS place_rank, CASE WHEN p_partkey % 11 = 0 THEN 'ca' ELSE 'us' END AS country,
               p_name || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' Town' || CAST(p_partkey % 50 AS STRING) END) AS name
        FROM {part}""",
    "town_queries": """
        SELECT c_custkey AS query_id, CASE c_custkey % 8
                   WHEN 0 THEN ' ' || upper(name) WHEN 1 THEN substr(name, 1, 2) || substr(name, 4) WHEN 2 THEN replace(name, 'i', 'y')
                   WHEN 3 THEN split_part(name, ' ', 2) WHEN 4 THEN 'x' || name WHEN 5 THEN 'zzzzzz ' || name WHEN 6 THEN '  '
                   ELSE split_part(name, ' ', 2) || '  ' || split_part(name, ' ', 1) END AS query
        FROM {customer} JOIN {towns} AS t ON place_id = c_custkey""",
    "label_queries": """
        SELECT s_suppkey AS query_id, CASE s_suppkey % 6
                   WHEN 0 THEN ' EN/src' || CAST(s_suppkey % 20 AS STRING) || ' ' WHEN 1 THEN 'c' || CAST(s_suppkey % 9 AS STRING) || '/' WHEN 2 THEN 'no such'
                   WHEN 3 THEN CAST(s_suppkey AS STRING) || '.PDF' WHEN 4 THEN CAST(s_suppkey AS STRING) || '.' ELSE 's/' END AS query
        FROM {supplier}""",
    "dirty": """
        SELECT doc_id, '\u00a0 ' || chr(1) || replace(replace(text, chr(10), chr(10) || chr(11) || chr(10) || chr(10)), ' ', '  ') || chr(127) || chr(9) || '\u2003 ' AS text
        FROM {documents}""",
    # Links of state index pages.
    "links": """
        SELECT c_custkey AS link_id, n_nationkey, 's' || CAST(n_nationkey AS STRING) AS state, c_custkey AS pos,
               'https://codes.example.com/' || (CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 's' || CAST(n_nationkey AS STRING) END) || '/' ||
               (CASE c_custkey % 8 WHEN 0 THEN 'codes' WHEN 1 THEN 'charter' ELSE 'town' || CAST(c_custkey % 40 AS STRING) END) || '/codes/x' AS href,
               CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_mktsegment || ' ' || CAST(c_custkey AS STRING) END AS text
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Pages whose headings are closed, left open, nested, crossed, hidden or empty.
    "soup_pages": """
        SELECT o_orderkey AS page_id, '<div class="a>b"><p>' || CAST(o_custkey AS STRING) || (CASE o_orderkey % 8
            WHEN 0 THEN '<h1>A ' || CAST(o_orderkey AS STRING) || '</h1> x'
            WHEN 1 THEN '<h2>B <i>' || CAST(o_orderkey AS STRING) || '</div> x'
            WHEN 2 THEN '<h1>C <h3>' || CAST(o_orderkey AS STRING) || '</h3> in</h1> x'
            WHEN 3 THEN '<h2>D <b>' || CAST(o_orderkey AS STRING) || '</h2> x</b> y'
            WHEN 4 THEN '<script>"<h1>no</h1>"</script><h4>E<template> no</template> ' || CAST(o_orderkey AS STRING) || '</h4><!-- <h2>no</h2> -->'
            WHEN 5 THEN '<h3/> x</h3> y <h3> <br></h3>'
            WHEN 6 THEN '<H2 title="</h2>">F</h3> &lt; ' || CAST(o_orderkey AS STRING) || ' </H2>'
            ELSE '<h1>G <h2>H ' || CAST(o_orderkey AS STRING) || '</h1> x</h2> y' END) || '</p></div> end' AS html
        FROM {orders}""",
    # Links found on municipality pages.
    "code_links": """
        SELECT 's' || CAST(o_custkey % 25 AS STRING) AS state, 'town' || CAST(o_custkey AS STRING) AS slug, o_orderkey AS pos,
               CASE o_orderkey % 9
                    WHEN 0 THEN 'https://codes.example.com/s/t/codes/zoning?n=' || CAST(o_orderkey AS STRING)
                    WHEN 1 THEN 'https://codes.example.com/s/t/codes/code_of_ordinances?n=' || CAST(o_orderkey AS STRING)
                    WHEN 2 THEN 'https://codes.example.com/s/t/codes/land_development?n=' || CAST(o_orderkey AS STRING)
                    WHEN 3 THEN 'https://codes.example.com/s' || CAST(o_custkey % 25 AS STRING) || '/town' || CAST(o_custkey AS STRING) || '/codes/' || CAST(o_orderkey AS STRING)
                    WHEN 4 THEN ''
                    ELSE 'https://codes.example.com/about/' || CAST(o_orderkey AS STRING) END AS href
        FROM {orders}""",
}

def _expand(text: str, known: dict[str, str], table_form: str) -> str:
    def one(match: re.Match) -> str:
        name = match[1]
        return f"({_expand(known[name], known, table_form)})" if name in known else table_form.format(name)

    return re.sub(r"\{(\w+)\}", one, text)


def fixture_sql(name: str) -> str:
    """Fixture text in which only tables are left in braces."""
    return _expand(FIXTURES[name], FIXTURES, "{{{}}}")


def oracle(text: str) -> str:
    """A query over fixtures and tables as plain SQL: fixtures become subqueries, tables plain names."""
    return _expand(text, FIXTURES, "{}").strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    text = fixture_sql(name)
    used = set(re.findall(r"\{(\w+)\}", text))
    return configure(spark).sql(text, **{t: table(spark, sf_dir, t) for t in used})


def geolabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label table with timestamps."""
    rows = frame(spark, sf_dir, "geolabels")
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    return rows.withColumns({"created_at": at("created_s"), "updated_at": at("updated_s")}).drop("created_s", "updated_s", "d")


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture of that name. Texts are hashed before the join, so hashes are shuffled and not the texts."""
    hashed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.md5("text").alias("pdf_hash"))
    moved = lambda lng, side: f"{lng}D + value / 1000D AS {side}_lng"
    return table(spark, sf_dir, "events").join(hashed, "user_id").selectExpr(
        "event_id", "ts", "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op", "pdf_hash",
        "concat('maps/event/', CAST(event_id AS STRING), '.pdf') AS pdf_path",
        moved("-85.9", "top_left"), "33.75D AS top_left_lat", moved("-85.8", "top_right"), "33.75D AS top_right_lat",
        moved("-85.8", "bottom_right"), "33.65D AS bottom_right_lat", moved("-85.9", "bottom_left"), "33.65D AS bottom_left_lat")


def nest_rings(vertices: DataFrame, *keys: str) -> DataFrame:
    """Polygons from a table of vertices."""
    vertex = F.struct("vertex_no", "x", "y")
    ring = F.transform(F.array_sort(F.collect_list(vertex)), lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    rings = vertices.groupBy("poly_id", *keys, "ring_no").agg(ring.alias("ring"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))), lambda r: r.ring)
    return rings.groupBy("poly_id", *keys).agg(nested.alias("rings"))


def comb_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture of that name with whole numbers of 64 bits and quotients in double precision, as the checking engine has them; no task sees all orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    counted = orders.agg(F.count("*").alias("n")).selectExpr("n", "CAST(floor(n / 2) AS BIGINT) AS half")
    numbered = ordered_row_number(orders, ["o_orderkey"], number_segment("o_orderkey"), name="row_no").selectExpr("CAST(row_no AS BIGINT) - 1 AS k")
    rows = numbered.join(F.broadcast(counted)).selectExpr(
        "1 AS poly_id", "0 AS zone_no", "0 AS ring_no", "k AS vertex_no",
        "IF(k < half, k * 5000D / half, (n - 1 - k) * 5000D / (n - half)) AS x",
        "CAST(IF(k < half, k % 2 * 2900 + k * 7919 % 100, 6000 - k % 2 * 2900 - k * 104729 % 100) AS DOUBLE) AS y")
    return rows.union(counted.selectExpr("1", "0", "0", "n", "0D", "0D"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_rings(frame(spark, sf_dir, "vertices"), "zone_no")


def faulty_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_rings(frame(spark, sf_dir, "faulty_vertices"), "shape")


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as stored: geometry as type and coordinate text, properties as a map, place in the file."""
    flat = frame(spark, sf_dir, "features")
    corner = lambda dx, dy: F.array(F.col("x0") + dx, F.col("y0") + dy)
    ring = F.array(F.array(corner(0, 0), corner(100, 0), corner(100, 100), corner(0, 100), corner(0, 0)))
    properties = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("id", "Zone_2024", "STREET_ADD", "QTRSEC_NUMBER", "area", "even", "corners", "note")]),
        F.array(*[c.cast("variant") for c in (
            F.col("id"), F.col("zone"), F.col("street"), F.col("sheet"), F.col("id") / 4, F.col("id") % 2 == 0,
            F.array("x0", "y0"), F.lit(None).cast("string"))]),
    )
    geometry = F.struct(F.lit("Polygon").alias("type"), F.to_json(ring).alias("coordinates"))
    return flat.select("id", "zone", geometry.alias("geometry"), properties.alias("properties"))


def landed_service_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a feature service as landed: one row per page, the body as text."""
    flat = frame(spark, sf_dir, "service_features")
    x, y = (F.col("id") % 50 * 100).cast("double"), (F.col("id") % 60 * 100).cast("double")
    point = lambda dx, dy: F.array(x + dx, y + dy)
    rings = F.array(F.array(point(0, 0), point(100, 0), point(100, 100), point(0, 100), point(0, 0)))
    paths = F.array(F.array(point(0, 0), point(50, 50)), F.array(point(60, 60), point(90, 90)))
    kind = F.col("kind")
    when = lambda k, v: F.when(kind == k, v)
    geometry = F.when(kind != "none", F.struct(
        when("rings", rings).alias("rings"), when("paths", paths).alias("paths"),
        when("point", x).alias("x"), when("point", y).alias("y"),
        when("curve", F.lit("arc")).alias("curve"),
    ))
    attributes = F.struct(
        F.col("id").alias("OBJECTID"), F.col("p_name").alias("NAME"), F.col("p_size").alias("SIZE"),
        F.col("own_tag").alias("_source_layer"),
    )
    listed = flat.select("layer_id", "page_no", F.struct("n", F.struct(attributes.alias("attributes"), geometry.alias("geometry")).alias("f")).alias("f"))
    texts = F.array_sort(F.collect_list(F.struct("f.n", F.to_json("f.f").alias("text"))))
    bodies = listed.groupBy("layer_id", "page_no").agg(F.transform(texts, lambda f: f.text).alias("_f"))
    pages = frame(spark, sf_dir, "service_pages").join(bodies, ["layer_id", "page_no"])
    body = (
        F.when(F.col("outcome") == "blank", F.lit("  "))
        .when(F.col("outcome") == "error", F.lit('{"error":{"code":400,"message":"bad request"}}'))
        .otherwise(F.concat(F.lit('{"features":['), F.array_join("_f", ","), F.lit("]}")))
    )
    return pages.select("layer_id", "layer_name", "page_no", F.lit(200).alias("status"), body.alias("body"))

"""Pages, links and tables of contents."""

from pyspark.sql import functions as F

from plotweave.fixtures import frame, table
from plotweave.functions import paths
from plotweave.operators import discovery as op
from plotweave.queries.registry import query
from plotweave.session import staging_path
from plotweave.sources import landed

_SITE = "https://codes.example.com"

_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"
_INNER = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("html_scan", "SELECT page_id, url, length(html) AS n FROM {pages}")
def _(spark, sf):
    return landed.html_scan(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("html_headings", """
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CAST(substr(h, 3, 1) AS INTEGER) AS level, <inner> AS text
    FROM (SELECT page_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h, unnest(hs) AS t
          FROM (SELECT page_id, regexp_extract_all(<visible>, '<heading>') AS hs FROM {pages}) AS a) AS b WHERE <inner> <> ''""",
       inner=_INNER, visible=_VISIBLE, heading=r"(?is)<h[1-4]\b[^>]*>.*?</h[1-4]\s*>")
def _(spark, sf):
    return op.html_headings(table(spark, sf, "pages"))


@query("nested_headings", """
    SELECT o_orderkey AS page_id, CAST(p AS INTEGER) AS pos, CAST(substr(h, 1, 1) AS INTEGER) AS level, substr(h, 3) AS text
    FROM (SELECT o_orderkey, unnest(range(0, len(hs))) AS p, unnest(hs) AS h
          FROM (SELECT o_orderkey, CASE o_orderkey % 8
                           WHEN 0 THEN ['1 A ' || k] WHEN 1 THEN ['2 B ' || k] WHEN 2 THEN ['1 C ' || k || ' in', '3 ' || k]
                           WHEN 3 THEN ['2 D ' || k] WHEN 4 THEN ['4 E ' || k] WHEN 5 THEN CAST([] AS VARCHAR[])
                           WHEN 6 THEN ['2 F < ' || k] ELSE ['1 G H ' || k, '2 H ' || k] END AS hs
                FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM {orders}) AS o) AS a) AS b""")
def _(spark, sf):
    return op.html_headings(frame(spark, sf, "soup_pages"))


@query("page_links", """
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(a, '<href>', 1) AS href, <inner> AS text
    FROM (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a, unnest(x) AS t
          FROM (SELECT page_id, regexp_extract_all(<visible>, '<anchor>') AS x FROM {pages}) AS l) AS b""",
       inner=_INNER, visible=_VISIBLE, anchor=r"""(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a\s*>""",
       href=r"""(?is)\bhref\s*=\s*["'']([^"'']*)["'']""")
def _(spark, sf):
    return op.page_links(table(spark, sf, "pages"))


@query("link_has_text", "SELECT link_id, href, text FROM {links} AS l WHERE href <> '' AND trim(text) <> ''")
def _(spark, sf):
    return op.link_has_text(frame(spark, sf, "links")).select("link_id", "href", "text")


@query("slug_stoplist", """
    SELECT link_id, split_part(href, '/', 5) AS slug FROM {links} AS l
    WHERE split_part(href, '/', 5) NOT IN ('codes', 'ordinances', 'charter', 'land_development')""")
def _(spark, sf):
    slugs = frame(spark, sf, "links").select("link_id", F.split("href", "/")[4].alias("slug"))
    return op.slug_stoplist(slugs)


@query("dedup_keep_first", """
    SELECT state, slug, name, 'https://codes.example.com/' || state || '/' || slug AS url
    FROM (SELECT state, split_part(href, '/', 5) AS slug, text AS name, row_number() OVER (PARTITION BY state, split_part(href, '/', 5) ORDER BY pos) AS rn
          FROM {links} AS l WHERE trim(text) <> '' AND split_part(href, '/', 4) = state) AS r
    WHERE rn = 1 AND slug NOT IN ('codes', 'ordinances', 'charter', 'land_development')""")
def _(spark, sf):
    return op.municipalities(frame(spark, sf, "links"), _SITE).select("state", "slug", "name", "url")


_PRIORITY = """CASE WHEN contains(href, 'codes/code_of_ordinances') THEN 0 WHEN contains(href, 'codes/zoning') THEN 1
                    WHEN contains(href, 'codes/land_development') THEN 2 WHEN contains(href, 'codes/unified_development') THEN 3
                    WHEN contains(href, '/' || state || '/' || slug || '/codes/') THEN 4 END"""


@query("codes_url_pick", f"""
    SELECT state, slug, arg_min(href, (p, pos)) AS codes_url
    FROM (SELECT *, {_PRIORITY} AS p FROM {{code_links}} AS c) AS x GROUP BY state, slug HAVING min(p) IS NOT NULL
    UNION ALL SELECT state, slug, NULL FROM (SELECT *, {_PRIORITY} AS p FROM {{code_links}} AS c) AS x GROUP BY state, slug HAVING min(p) IS NULL"""
       .replace("arg_min(href, (p, pos))", "arg_min(href, p * 1000000000000 + pos)"))
def _(spark, sf):
    return op.codes_url_pick(frame(spark, sf, "code_links"))


def _tocs(spark, sf):
    """Landed table-of-contents documents, one per root."""
    rows = frame(spark, sf, "toc")
    child = F.when(F.col("child_no").isNotNull(), F.struct("heading", "node_id"))
    docs = rows.groupBy("root_heading", "root_id").agg(F.collect_list(child).alias("children"))
    path = staging_path(spark, "toc")
    docs.select(F.to_json(F.struct("root_heading", "root_id", "children")).alias("value")).write.text(path)
    return op.parse_toc(spark.read.text(path))


_PATH = "root_heading || coalesce('⫸' || heading, '')"


@query("toc_flatten", f"""
    SELECT {_PATH} AS path, CASE WHEN heading IS NOT NULL THEN root_id END AS parent_node_id, coalesce(node_id, root_id) AS node_id FROM {{toc}} AS t""")
def _(spark, sf):
    sections = op.toc_flatten(_tocs(spark, sf))
    return sections.select(F.array_join("path", paths.SECTION_SEPARATOR).alias("path"), "parent_node_id", "node_id")


@query("section_file_name", f"""
    SELECT coalesce(node_id, root_id) AS node_id, replace(replace({_PATH}, '/', '-'), chr(92), '-') || '.docx' AS file_name FROM {{toc}} AS t""")
def _(spark, sf):
    sections = op.toc_flatten(_tocs(spark, sf))
    return sections.select("node_id", paths.section_file_name(F.col("path")).alias("file_name"))


@query("section_title_parts", """
    SELECT coalesce(node_id, root_id) AS node_id, replace(replace(root_heading, '/', '-'), chr(92), '-') AS document_title,
           replace(heading, '/', '-') AS document_subtitle FROM {toc} AS t""")
def _(spark, sf):
    sections = op.toc_flatten(_tocs(spark, sf))
    parts = paths.section_title_parts(paths.section_file_name(F.col("path")))
    return sections.select("node_id", parts.alias("p")).select("node_id", "p.document_title", "p.document_subtitle")


@query("supported_key", """
    SELECT c_custkey, n_regionkey IN (0, 1, 2) AS supported FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""")
def _(spark, sf):
    registry = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("city"))
    asked = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("city"))
    ok, rejected = op.supported_key(asked, registry)
    both = ok.withColumn("supported", F.lit(True)).unionByName(rejected.withColumn("supported", F.lit(False)))
    return both.select("c_custkey", "supported")

"""Text, names and URLs."""

from pyspark.sql import functions as F

from plotweave.fixtures import frame, table
from plotweave.functions import paths, text, urls
from plotweave.operators import discovery as disc
from plotweave.queries.registry import query

# The checking engine's form of Unicode white space.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(sql):
    return f"regexp_replace(regexp_replace({sql}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_CLEAN = _strip(
    r"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')"
)
_TITLE = _strip(r"regexp_replace(text, '[^\p{L}\p{N}_\t-\r\x1c-\x20-]', '', 'g')")


@query("norm_text", """
    SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '<space>+', ' ', 'g'))) AS text FROM {dirty} AS d""", space=_SPACE)
def _(spark, sf):
    return frame(spark, sf, "dirty").select("doc_id", text.norm_text(F.col("text")).alias("text"))


@query("clean_text", "SELECT doc_id, <clean> AS text FROM {dirty} AS d", clean=_CLEAN)
def _(spark, sf):
    return frame(spark, sf, "dirty").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("safe_title", "SELECT doc_id, replace(<title>, ' ', '_') AS title FROM {documents}", title=_TITLE)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.safe_title(F.col("text")).alias("title"))


@query("slugify", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM {part}")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("pages_to_document", """
    SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM {conversations} GROUP BY conv_id""")
def _(spark, sf):
    return disc.pages_to_document(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("page_explode", """
    SELECT doc_id, CAST(i AS INTEGER) AS page_no, CAST(doc_id AS VARCHAR) || '_page_' || printf('%03d', i) AS page_name, text
    FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS text
          FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {documents}) AS s) AS x""")
def _(spark, sf):
    return disc.page_explode(table(spark, sf, "documents"), "\n")


@query("url_domain", r"SELECT url_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain FROM {viewer_urls} AS u")
def _(spark, sf):
    return frame(spark, sf, "viewer_urls").select("url_id", urls.url_domain(F.col("url")).alias("domain"))


@query("url_layer_id", """
    SELECT url_id, CASE WHEN url_id % 8 = 6 THEN NULL ELSE expected END AS layer_id FROM {viewer_urls} AS u""")
def _(spark, sf):
    return frame(spark, sf, "viewer_urls").select("url_id", urls.url_layer_id(F.col("url")).alias("layer_id"))


@query("service_layer_url", """
    SELECT page_id, 'https://services.example.com/' || CAST(page_id AS VARCHAR) || '/FeatureServer/0' AS layer_url FROM {pages}""")
def _(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, "/0").when(F.col("page_id") % 3 == 1, "/").otherwise("")
    url = F.concat(F.lit("https://services.example.com/"), F.col("page_id").cast("string"), F.lit("/FeatureServer"), tail)
    return table(spark, sf, "pages").select("page_id", urls.service_layer_url(url).alias("layer_url"))


@query("url_path_parts", """
    SELECT link_id, split_part(path, '/', 1) AS part0, split_part(path, '/', 2) AS part1, len(string_split(path, '/')) AS n_parts
    FROM (SELECT link_id, trim(replace(href, 'https://codes.example.com', ''), '/') AS path FROM {links} AS l) AS p""")
def _(spark, sf):
    parts = urls.url_path_parts(F.col("href"), "https://codes.example.com")
    split = frame(spark, sf, "links").select("link_id", parts.alias("p"))
    return split.select("link_id", F.col("p")[0].alias("part0"), F.col("p")[1].alias("part1"), F.size("p").cast("bigint").alias("n_parts"))


@query("url_filename", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS file_name FROM {pages}")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.url_filename(F.col("url")).alias("file_name"))

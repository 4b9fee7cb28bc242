"""Pages, links and tables of contents: finding what to collect."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import paths
from plotweave.functions.markup import elements_of
from plotweave.functions.text import WHITE_SPACE, strip
from plotweave.functions.urls import url_path_parts
from plotweave.plans.picking import dedup_keep_first
from plotweave.plans.skew import salted_join
from plotweave.schemas import TOC

# Path parts of a code site that are no municipality.
SLUG_STOPLIST = ("codes", "ordinances", "charter", "land_development")
# What a link to the code itself contains, best first.
CODES_PATTERNS = (
    "codes/code_of_ordinances",
    "codes/zoning",
    "codes/land_development",
    "codes/unified_development",
)
#: Character references: decimal, hexadecimal, or a name of HTML 4.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def shown_text(text: Column) -> Column:
    """Text between tags as a reader sees it: references resolved, white space collapsed."""
    return strip(F.regexp_replace(resolve_references(text), f"{WHITE_SPACE}+", " "))


def _character(reference: Column) -> Column:
    """What one reference stands for; unknown names and numbers outside Unicode stay as written."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])
    body = F.substr(reference, F.lit(2), F.length(reference) - 2)
    digits = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
    code = F.when(F.startswith(body, F.lit("#")), digits.try_cast("int"))
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.isNull(), F.coalesce(F.try_element_at(names, body), reference)).when(valid, character).otherwise(reference)


def resolve_references(text: Column) -> Column:
    """Text with its character references resolved, each once: ``&amp;lt;`` becomes ``&lt;``."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    pieces = F.zip_with(F.split(text, REFERENCE, -1), found, lambda plain, ref: F.concat(plain, F.when(ref.isNull(), "").otherwise(_character(ref))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def html_headings(pages: DataFrame, nested: bool = True) -> DataFrame:
    """Headings h1 to h4 with text, in document order.

    Headings are nested as a tag-soup parser nests them (``markup.elements``): one left open ends with the element around
    it, and one inside another is part of its text and a heading of its own. Pages without HTML have none.
    """
    found = elements_of(F.col("html"), ("h1", "h2", "h3", "h4"), nested=nested)
    headings = F.transform(
        "_found", lambda h: F.struct(F.substring(h["name"], 2, 1).cast("int").alias("level"), shown_text(h["text"]).alias("text"))
    )
    read = pages.select("page_id", found.alias("_found")).select("page_id", headings.alias("_headings"))
    kept = F.filter("_headings", lambda h: h.getField("text") != "")
    return read.select("page_id", F.posexplode(kept).alias("pos", "_h")).select("page_id", "pos", "_h.level", "_h.text")


def page_links(pages: DataFrame, *keep: str, nested: bool = True) -> DataFrame:
    """Anchors with an address, in page order, with address and text; nested as headings are."""
    found = elements_of(F.col("html"), ("a",), "href", nested)
    linked = F.filter("_found", lambda a: a["value"].isNotNull())
    read = pages.select("page_id", *keep, found.alias("_found")).select("page_id", *keep, F.posexplode(linked).alias("pos", "_a"))
    return read.select(
        "page_id", *keep, "pos", resolve_references(F.col("_a.value")).alias("href"), shown_text(F.col("_a.text")).alias("text")
    )


def link_has_text(links: DataFrame) -> DataFrame:
    return links.where((F.coalesce("href", F.lit("")) != "") & (strip(F.coalesce("text", F.lit(""))) != ""))


def slug_stoplist(df: DataFrame, words: Sequence[str] = SLUG_STOPLIST, column: str = "slug") -> DataFrame:
    return df.where(~F.col(column).isin(*words))


def municipalities(links: DataFrame, base_url: str) -> DataFrame:
    """Municipalities a state's link list names: the first link per slug, real places only.

    ``links`` has ``state, pos, href, text``; parts of the site that are no place are dropped after
    the first-link rule, as every one of them would be anyway.
    """
    parts = url_path_parts(F.col("href"), base_url)
    split = link_has_text(links).withColumn("_parts", parts).where(
        (F.size("_parts") >= 2) & (F.col("_parts")[0] == F.col("state"))
    )
    named = split.select("state", F.col("_parts")[1].alias("slug"), "pos", F.col("text").alias("name"))
    first = dedup_keep_first(named, ["state", "slug"], ["pos"])
    url = F.concat_ws("/", F.lit(base_url), "state", "slug")
    return slug_stoplist(first).withColumn("url", url).drop("pos")


def codes_url_pick(links: DataFrame, patterns: Sequence[str] = CODES_PATTERNS) -> DataFrame:
    """The link to a municipality's code: best pattern first, then page order; null if none.

    ``links`` has ``state, slug, pos, href``. The handful of patterns are tried as one expression, so
    there is no pattern table to join.
    """
    own = F.concat(F.lit("/"), F.col("state"), F.lit("/"), F.col("slug"), F.lit("/codes/"))
    priority = F.lit(None).cast("int")
    tests = [F.contains("href", F.lit(p)) for p in patterns] + [F.contains(F.col("href"), own)]
    for rank in reversed(range(len(tests))):
        priority = F.when(tests[rank], rank).otherwise(priority)
    # Rows without priority do not count as a minimum, so a place without a link gets null. The minimum is
    # combined before the shuffle.
    ranked = links.withColumn("_priority", priority)
    rank = F.when(F.col("_priority").isNotNull(), F.struct("_priority", "pos"))
    return ranked.groupBy("state", "slug").agg(F.min_by("href", rank).alias("codes_url"))


def toc_flatten(tocs: DataFrame) -> DataFrame:
    """Sections of two-level tables of contents.

    A root with children gives one section per child; a root without gives one of its own, with no parent.
    """
    parsed = tocs.select("*", F.coalesce("children", F.array().cast("array<struct<heading:string,node_id:string>>")).alias("_c"))
    sections = parsed.select("root_heading", "root_id", F.posexplode_outer("_c").alias("pos", "_child"))
    childless = F.col("_child").isNull()
    root = strip(F.col("root_heading"))
    return sections.select(
        F.when(childless, F.array(root)).otherwise(F.array(root, strip(F.col("_child.heading")))).alias("path"),
        F.when(~childless, F.col("root_id")).alias("parent_node_id"),
        F.when(childless, F.col("root_id")).otherwise(F.col("_child.node_id")).alias("node_id"),
    )


def parse_toc(lines: DataFrame, column: str = "value") -> DataFrame:
    """Landed table-of-contents documents, one JSON text per row."""
    return lines.select(F.inline(F.array(F.from_json(column, TOC))))


def supported_key(df: DataFrame, registry: DataFrame, column: str = "city", base_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is registered (and whose URL starts with the site's base), and the rejected rest."""
    known = registry.select(F.col(column), F.lit(True).alias("_known")).distinct()
    marked = salted_join(df, known, [column], salt_by=df.columns, how="left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    if base_url is not None:
        marked = marked.withColumn("_known", F.col("_known") & F.coalesce(F.startswith("url", F.lit(base_url)), F.lit(False)))
    return marked.where("_known").drop("_known"), marked.where(~F.col("_known")).drop("_known")


def pages_to_document(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Page texts of each document in page order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    joined = F.array_join(F.transform(ordered, lambda p: p.getField(text)), "\n\n")
    return pages.groupBy(doc).agg(joined.alias("text"))


def page_explode(docs: DataFrame, separator: str = "\n\n", stem: Column | None = None) -> DataFrame:
    """One row per page of a document text, named after the document with a 1-based page number."""
    named = docs.withColumn("_stem", F.col("doc_id").cast("string") if stem is None else stem)
    split = named.select("doc_id", "_stem", F.posexplode(F.split("text", separator)).alias("_pos", "text"))
    page_no = F.col("_pos") + 1
    return split.select("doc_id", page_no.alias("page_no"), paths.page_name(F.col("_stem"), page_no).alias("page_name"), "text")

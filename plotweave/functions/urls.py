"""URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import blank_to_null

# Where a layer id may stand outside the query string, in order of preference.
LAYER_ID_PATTERNS = (
    r"layers=([a-f0-9]{32})",
    r"id=([a-f0-9]{32})",
    r"/items/([a-f0-9]{32})",
)


def url_domain(url: Column) -> Column:
    """Network location, port kept (the HOST part would drop it)."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def _query_value(url: Column, name: str) -> Column:
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return blank_to_null(F.try_url_decode(raw))


def url_layer_id(url: Column, strict: bool = False) -> Column:
    """Layer id of a map viewer URL; null when there is none, or an error in strict mode."""
    found = [_query_value(url, "layers"), _query_value(url, "id")]
    found += [blank_to_null(F.regexp_extract(url, pattern, 1)) for pattern in LAYER_ID_PATTERNS]
    if strict:
        found.append(F.raise_error(F.concat(F.lit("no layer id in URL: "), url)))
    return F.coalesce(*found)


def service_layer_url(url: Column, index: int = 0) -> Column:
    """URL of one layer of a service, whether or not the index is already there."""
    tail = f"/{index}"
    return (
        F.when(F.endswith(url, F.lit(tail)), url)
        .when(F.endswith(url, F.lit("/")), F.concat(url, F.lit(str(index))))
        .otherwise(F.concat(url, F.lit(tail)))
    )


def url_path_parts(url: Column, base: str) -> Column:
    """Path segments after the site's base, outer slashes removed."""
    path = F.replace(url, F.lit(base), F.lit(""))
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def ordinance_link(code: Column, base: str) -> Column:
    """Link into an online ordinance; spaces are written %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(code), F.lit("+"), F.lit("%20")))

"""Paths and keys of stored files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the headings of a section into one file name.
SECTION_SEPARATOR = "⫸"
MAPS_PREFIX = "maps/"


def content_addressed_layout(md5: Column, suffix: str = "") -> Column:
    """Object key of a content hash: two-character fan-out, then the rest."""
    return F.concat(F.lit("files/md5/"), F.substring(md5, 1, 2), F.lit("/"), F.substr(md5, F.lit(3)), F.lit(suffix))


def relative_layout(path: Column, src: str, dst: str) -> Column:
    """Move a path from below ``src`` to below ``dst``, sub-folders kept, with forward slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    root = src.replace("\\", "/").rstrip("/") + "/"
    inner = F.when(F.startswith(slashed, F.lit(root)), F.substr(slashed, F.lit(len(root) + 1))).otherwise(slashed)
    return F.concat(F.lit(dst.rstrip("/") + "/"), inner)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: The file name a URL points to is its last segment.
url_filename = last_segment


def segment(path: Column, index: int) -> Column:
    """Path part by 0-based position, empty when there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(index + 1)), F.lit(""))


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]+$", "")


def page_name(stem: Column, page_no: Column) -> Column:
    """Name of a single page, 1-based with three digits."""
    return F.format_string("%s_page_%03d", stem, page_no)


def section_file_name(path: Column) -> Column:
    """File name of a section from its heading path; slashes would break the name."""
    joined = F.array_join(path, SECTION_SEPARATOR)
    return F.concat(F.translate(joined, "/\\", "--"), F.lit(".docx"))


def section_title_parts(file_name: Column) -> Column:
    """Title and subtitle back from a section's file name."""
    parts = F.split(F.regexp_replace(file_name, r"\.docx$", ""), SECTION_SEPARATOR)
    return F.struct(
        F.element_at(parts, 1).alias("document_title"),
        F.try_element_at(parts, F.lit(2)).alias("document_subtitle"),
    )


def storage_prefix(state: Column, city: Column, root: str = "zoning_ordinance") -> Column:
    return F.concat_ws("/", F.lit(root), state, city)


def public_url(path: Column, bucket: str, host: str = "https://storage.googleapis.com") -> Column:
    return F.concat(F.lit(f"{host}/{bucket}/"), path)


def document_url(path: Column) -> Column:
    """Where a catalogued document is served, from its catalog path."""
    return F.concat(F.lit("/api/pdf/"), path)


def display_label(state: Column, city: Column, name: Column) -> Column:
    return F.concat_ws("/", state, city, name)


def page_label(page: Column, total: Column) -> Column:
    return F.format_string("Page %d of %d", page, total)


def coordinate_label(lat: Column, lng: Column) -> Column:
    """Position with four decimals and hemisphere letters."""
    north = F.when(lat < 0, "S").otherwise("N")
    east = F.when(lng < 0, "W").otherwise("E")
    return F.format_string("%.4f°%s, %.4f°%s", F.abs(lat), north, F.abs(lng), east)


def b64_md5_to_hex(b64: Column) -> Column:
    return F.lower(F.hex(F.unbase64(b64)))


def content_matches(md5: Column, remote_b64: Column) -> Column:
    """True only when the remote hash exists and equals ours."""
    remote = F.nullif(remote_b64, F.lit(""))
    return F.coalesce(b64_md5_to_hex(remote) == md5, F.lit(False))

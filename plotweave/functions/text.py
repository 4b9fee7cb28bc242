"""Text clean-up with Unicode-aware white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters a Unicode-aware strip removes.
# Java's \s is ASCII only and TRIM removes only U+0020.
WHITE_SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITE_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Control characters dropped from document text (tab, LF and CR stay).
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
# Characters a file title may hold besides white space and hyphen.
WORD = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends: a trim with the set spelled out."""
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def norm_text(text: Column) -> Column:
    """Comparable form of a text: one space between words, no outer space, lower case, never null."""
    collapsed = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE_SPACE}+", " ")
    return F.lower(F.trim(collapsed))


def clean_text(text: Column) -> Column:
    """Document text without control characters, runs of blank lines and runs of spaces."""
    printable = F.regexp_replace(text, CONTROL, "")
    paragraphs = F.regexp_replace(printable, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(paragraphs, " {2,}", " "))


def safe_title(title: Column) -> Column:
    """A title as file name stem: word characters, hyphens and underscores only."""
    kept = F.regexp_replace(title, f"(?:(?!{WHITE_SPACE})[^{WORD}-])", "")
    return F.replace(strip(kept), F.lit(" "), F.lit("_"))


def slugify(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def format_count(n: Column) -> Column:
    """Thousands separators, no decimals."""
    return F.format_number(n, 0)

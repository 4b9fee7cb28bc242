"""Elements of HTML pages, nested as a tag-soup parser nests them."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never have content.
VOID = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
    "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
))
# Elements whose content is no markup, and elements whose text is not part of the text around them.
RAW = ("script", "style")
HIDDEN = frozenset(("rp", "rt", "script", "style", "template"))

ELEMENT = "struct<name:string,value:string,text:string>"

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_KEY = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Token(NamedTuple):
    """A piece of text (no name), a start tag or an end tag."""

    name: str = ""
    text: str = ""
    closes: bool = False
    empty: bool = False
    attributes: dict[str, str] = {}


def tokens(page: str) -> Iterator[Token]:
    """Text, start and end tags of a page, in time linear in its length.

    A ``<`` that starts no tag is text. Quoted values may hold ``>``; a quote that never closes is an ordinary
    character. A comment, tag or script that never ends takes the rest of the page with it.
    """
    at, size, unclosed = 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield Token(text=page[at:])
            return
        if start > at:
            yield Token(text=page[at:start])
        if page.startswith("<!--", start):
            end, skip = page.find("-->", start + 4), 3
        elif page.startswith(("<!", "<?"), start):
            end, skip = page.find(">", start), 1
        elif (name := _NAME.match(page, start + 2)) and page[start + 1] == "/":
            end, skip = page.find(">", name.end()), 1
            if end >= 0:
                yield Token(name[0].lower(), closes=True)
        elif page.startswith("</", start):
            end, skip = page.find(">", start), 1
        elif name := _NAME.match(page, start + 1):
            kind, (end, attributes) = name[0].lower(), _attributes(page, name.end(), unclosed)
            skip = 1
            if end >= 0:
                empty = page[end - 1] == "/"
                yield Token(kind, empty=empty, attributes=attributes)
                if kind in RAW and not empty:
                    closing = _RAW_END[kind].search(page, end)
                    end, skip = (closing.start(), 0) if closing else (-1, 0)
        else:
            yield Token(text="<")
            end, skip = start, 1
        if end < 0:
            return
        at = end + skip


def _attributes(page: str, at: int, unclosed: set[str]) -> tuple[int, dict[str, str]]:
    """Place of the ``>`` that ends a start tag (-1 if none does) and its attributes; of repeated ones the last."""
    found: dict[str, str] = {}
    while key := _KEY.match(page, at):
        at, value = key.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote, end = page[at:at + 1], -1
            if quote in ("'", '"') and quote not in unclosed:
                end = page.find(quote, at + 1)
                if end < 0:  # no later search for this quote can succeed
                    unclosed.add(quote)
            if end >= 0:
                value, at = page[at + 1:end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found[key[1].lower()] = value
    return page.find(">", at), found


def elements(page: str, wanted: Collection[str], attribute: str | None = None, nested: bool = True) -> list[tuple[str, str | None, str]]:
    """Elements of the wanted names in order of their start tags: name, value of the attribute, text inside.

    An end tag closes the innermost open element of its name and all that is open within; without one it is ignored.
    Elements never closed by their own end tag end with the element around them, or with the page. An element's text holds
    that of elements within it. With ``nested`` false it ends where the next wanted element starts, which keeps the result
    no longer than the page however many are left open.
    """
    stack: list[tuple[str, int]] = []  # name, and place in found or -1
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    found: list[list] = []  # name, value, first piece, piece after the last
    hidden, last = 0, -1

    def close() -> None:
        nonlocal hidden
        name, place = stack.pop()
        opened[name] -= 1
        hidden -= name in HIDDEN
        if place >= 0 and found[place][3] is None:
            found[place][3] = len(pieces)

    for token in tokens(page):
        if not token.name:
            if not hidden:
                pieces.append(token.text)
        elif token.closes:
            if opened[token.name]:
                while stack[-1][0] != token.name:
                    close()
                close()
        else:
            place = -1
            if token.name in wanted:
                if not nested and last >= 0 and found[last][3] is None:
                    found[last][3] = len(pieces)
                place = last = len(found)
                found.append([token.name, token.attributes.get(attribute), len(pieces), None])
            stack.append((token.name, place))
            opened[token.name] += 1
            hidden += token.name in HIDDEN
            if token.empty or token.name in VOID:
                close()
    while stack:
        close()
    return [(name, value, "".join(pieces[first:end])) for name, value, first, end in found]


def elements_of(html: Column, wanted: Collection[str], attribute: str | None = None, nested: bool = True) -> Column:
    """``elements`` of every page as an array, texts as written; null pages give null."""
    names = frozenset(wanted)

    def read(pages: pa.Array) -> pa.Array:
        rows = [None if page is None else [
            {"name": name, "value": value, "text": text} for name, value, text in elements(page, names, attribute, nested)
        ] for page in pages.to_pylist()]
        kind = pa.struct([("name", pa.string()), ("value", pa.string()), ("text", pa.string())])
        return pa.array(rows, pa.list_(kind))

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    read.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, f"array<{ELEMENT}>").asNondeterministic()(html)

"""Token sequences packed by bounded-space online best fit."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of

#: Tokens of a sequence.
SEQUENCE_TOKENS = 2048
#: Bins a task holds open, and pieces it reads ahead. A task keeps at most so many sequences and pieces in memory.
OPEN_BINS, READ_AHEAD = 512, 1024
#: Bins a task of a later round takes, as a multiple of the bins it may leave open.
ROUND_FACTOR = 16
#: The id that ends a document.
END_ID = 0
#: Words whose ids a task remembers, and the longest such word.
WORDS, LONGEST_WORD = 300_000, 64
#: Bytes of text split into words at a time.
SLAB = 1 << 20

#: How the tokenizer's file cuts words; fixed value, compared with the file before the same cut is used on plain words.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same cut for lower-cased words of printable ASCII and composed Latin letters, which no normalisation but lower case changes.
LATIN = r"\u00df-\u00f6\u00f8-\u017e"
PLAIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")
#: Bytes as the signs that stand for them in merges: printable Latin-1 stands for itself, the others follow from U+0100 on.
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit numbers.

    Holds for tokenizers that never join characters across white space and lower-case what they read. A part of a plain word goes to the
    merge model directly, any other word through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.parts = tokenizer, tokenizer.model, {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            signs = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_SIGNS)
            ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
            if len(part) <= LONGEST_WORD:
                if len(self.parts) >= WORDS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self._part(p) for p in PLAIN_PARTS.findall(text.lower())])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def encoder(tokenizer_json: str):
    """``bytes of UTF-8 -> bytes of ids``; ids as the tokenizer gives them for the whole text, without special tokens of its own."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    spec = json.loads(tokenizer_json)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if steps[0].get("pattern") != {"Regex": WORD_PARTS} or {"type": "Lowercase"} not in (spec["normalizer"] or {}).get("normalizers", []):
        return lambda data: array("I", tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
    known = WordIds(tokenizer)
    border = re.compile(rb"[\x20\x09-\x0D]")

    def encode(data: bytes) -> bytes:
        ids, at = [], 0
        while at < len(data):
            cut = border.search(data, at + SLAB)
            end = cut.start() if cut else len(data)
            ids.extend([known[w] for w in data[at:end].split()])
            at = end
        return b"".join(ids)

    return encode


class OpenBins:
    """At most ``limit`` open bins; a set bit tells that bins with so much free space are open."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.free, self.n = 0, [[] for _ in range(size + 1)], 0

    def _take(self, space: int) -> list:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.n -= 1
        return found

    def place(self, length: int, item) -> list[list]:
        """Put the item into the fullest bin that holds it, else into a new one, for which the fullest closes if all are in use. Returns closed bins."""
        closed, fitting = [], self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            into = self._take(space)
        else:
            if self.n == self.limit and length < self.size:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            space, into = self.size, []
        into.append(item)
        space -= length
        if space == 0:
            closed.append(into)
        else:
            self.free[space].append(into)
            self.bits |= 1 << space
            self.n += 1
        return closed

    def rest(self) -> list[list]:
        return [into for bins in self.free for into in bins]


def _schema(like: DataFrame, doc_id: str):
    from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

    return StructType([
        StructField("doc_id", like.schema[doc_id].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType()), StructField("filled", LongType()), StructField("closed", BooleanType())])


def _longest_first(items: Iterator[tuple[int, list]], n: int) -> Iterator[tuple[int, list]]:
    """The items in groups of ``n`` as they come, each group by falling length: short ones then fill what long ones leave."""
    while group := list(islice(items, n)):
        yield from sorted(group, key=lambda item: -item[0])


def _packed(items: Iterator[tuple[int, list]], size: int, limit: int, ahead: int, first: int, arrow: pa.Schema, last_round: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the bins that items (length, pieces with their place in it) go to, bin by bin as they close."""
    bins, rows, pending, number = OpenBins(size, limit), [], 0, first

    def emit(into: list, closed: bool) -> None:
        nonlocal number, pending
        at = 0
        filled = sum(length for length, _ in into)
        for length, pieces in into:
            for doc, piece, start, n, ids, place in pieces:
                rows.append((doc, piece, start, n, ids, number, at + place, filled, closed))
                pending += len(ids)
            at += length
        number += 1

    def flush() -> pa.RecordBatch:
        nonlocal pending
        columns = list(zip(*rows)) or [()] * len(arrow)
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        rows.clear()
        pending = 0
        return batch

    for length, pieces in _longest_first(items, ahead):
        for into in bins.place(length, (length, pieces)):
            emit(into, True)
        if pending > 4 << 20:
            yield flush()
    for into in bins.rest():
        emit(into, last_round)
        if pending > 4 << 20:
            yield flush()
    yield flush()


def _first_number(round_no: int) -> int:
    """Sequences are numbered by round, task and order in the task, so that a task that runs again gives the same numbers."""
    return (round_no << 56) + (TaskContext.get().partitionId() << 32)


def pack_sequences(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS,
                   open_bins: int = OPEN_BINS, read_ahead: int = READ_AHEAD, round_factor: int = ROUND_FACTOR) -> DataFrame:
    """Pieces of all documents and their places: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    A document is its ids and ``END_ID``; only what is longer than ``size`` is cut, into pieces of ``size`` and a last one. ``ids`` are
    little-endian unsigned 32-bit numbers. A sequence holds whole pieces, one after the other from offset 0.

    1. Every task tokenizes its part of the documents and packs it as it reads, without a shuffle: a piece goes into the fullest of the open
       bins that holds it. Where none does and all are in use, the fullest closes. Pieces come in groups of ``read_ahead``, longest first.
    2. Bins still open at the end of a task are the pieces of the next round, with ``round_factor`` times as many bins
       to a task as one leaves open; so each round is a fraction of the one before, and the last, of one task, closes all.

    A task holds ``open_bins`` sequences, ``read_ahead`` pieces and one document. Each round is written to the shared folder once, so a lost executor changes
    no place. ``tokenizer`` is the path of a file of the tokenizers library, read on the driver (a few MB) and sent along.

    Null and empty texts have the end id only. Repeated rows and null ids are documents of their own. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    schema = _schema(docs, doc_id)
    from pyspark.sql.pandas.types import to_arrow_schema

    def first_round(batches):
        encode, end = encoder(vocabulary.value), array("I", [END_ID]).tobytes()
        arrow = to_arrow_schema(schema)

        def items():
            for batch in batches:
                for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(data.as_py()) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at:at + 4 * size]
                        yield len(part) // 4, [(doc, piece, at // 4, len(part) // 4, part, 0)]

        yield from _packed(items(), size, open_bins, read_ahead, _first_number(0), arrow, False)

    def later_round(number: int, last: bool):
        def pack(batches):
            def items():
                seen, pieces, filled = None, [], 0
                for batch in batches:
                    for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids", "offset", "sequence_id", "filled")]):
                        if row[6] != seen and pieces:
                            yield filled, pieces
                            pieces = []
                        seen, filled = row[6], row[7]
                        pieces.append(row[:6])
                if pieces:
                    yield filled, pieces

            yield from _packed(items(), size, open_bins, read_ahead, _first_number(number), to_arrow_schema(schema), last)

        return pack

    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).cast("binary").alias("data"))
    done = staged(texts.mapInArrow(first_round, schema), "packed")
    rounds, number = [done.where("closed")], 1
    left = done.where("NOT closed")
    while (n := left.where("offset = 0").count()) > 0:
        tasks = -(-n // (round_factor * open_bins))
        dealt = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")
        done = staged(dealt.mapInArrow(later_round(number, tasks == 1), schema), "packed")
        rounds.append(done.where("closed"))
        left, number = done.where("NOT closed"), number + 1
    result = rounds[0]
    for one in rounds[1:]:
        result = result.unionByName(one)
    return result.drop("filled", "closed")


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids' bytes."""
    return F.crc32(ids)

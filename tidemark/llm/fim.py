"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: the text's UTF-8 bytes and SENTINELS. Cutting
splits descriptors, an arrangement permutes them and sets sentinels between them, the inverse permutation restores the text, and digests read
the descriptors one after another, so that no text is put together for them. Texts are read where Arrow keeps them.

A text has n tokens (runs of A-Za-z, or any other one character) and is cut before two of its n + 1 places, which a hash of its id picks,
as it picks the form: psm (prefix, suffix, middle), spm (suffix, prefix, middle), or plain, the text as it is. A text that is empty (null
counts as empty) or has a sentinel itself is plain, so that an output can always be read back. A null id counts as an empty one. Rows
are independent; equal rows have equal results; other columns stay as they are where texts are returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, texts

SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (0, 3), (3, 6), (6, 9)
TEXT, SENTINEL = 0, 1
#: The order of prefix (0), suffix (1) and middle (2) in each form, and that of a form's parts in the text.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
MARKS = (PREFIX, SUFFIX, MIDDLE)
Piece = tuple[int, int, int]


def split(table: list[Piece], at: int) -> list[Piece]:
    """The table with an edge at byte `at` of what it stands for."""
    out, done = [], 0
    for buffer, start, end in table:
        if done < at < done + end - start:
            out += [(buffer, start, start + at - done), (buffer, start + at - done, end)]
        else:
            out.append((buffer, start, end))
        done += end - start
    return out


def part(table: list[Piece], start: int, end: int) -> list[Piece]:
    """The descriptors between two edges."""
    out, done = [], 0
    for piece in table:
        if start <= done and done + piece[2] - piece[1] <= end and piece[2] > piece[1]:
            out.append(piece)
        done += piece[2] - piece[1]
    return out


def arranged(size: int, low: int, high: int, form: str) -> list[Piece]:
    """The table of a text of `size` bytes, cut at low and high, in a form."""
    table = [(TEXT, 0, size)]
    if form == "plain":
        return table
    table = split(split(table, low), high)
    parts = part(table, 0, low), part(table, high, size), part(table, low, high)
    return [piece for k in ORDERS[form] for piece in ((SENTINEL, *MARKS[k]), *parts[k])]


def restored(output: bytes, form: str) -> list[Piece]:
    """The table, over the output as its text, of the text that it was made from."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    first, second, third = (SENTINELS[slice(*MARKS[k])] for k in ORDERS[form])
    a = output.index(second)
    b = output.index(third, a + 3)
    if not output.startswith(first):
        raise ValueError("not an output of this form")
    found = {k: (TEXT, *span) for k, span in zip(ORDERS[form], ((3, a), (a + 3, b), (b + 3, len(output))), strict=True)}
    return [found[0], found[2], found[1]]


def stream(table: Iterable[Piece], text: memoryview) -> Iterator[memoryview]:
    buffers = text, memoryview(SENTINELS)
    for buffer, start, end in table:
        yield buffers[buffer][start:end]


def digest(table: Iterable[Piece], text: memoryview) -> str:
    found = hashlib.sha256()
    for view in stream(table, text):
        found.update(view)
    return found.hexdigest()


def tokens(text: np.ndarray) -> np.ndarray:
    """Where the tokens of UTF-8 bytes start."""
    letter = ((text | 0x20) >= 0x61) & ((text | 0x20) <= 0x7A)
    start = (text & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def chars(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def marked(text: np.ndarray) -> bool:
    """Whether a sentinel stands in the text."""
    return len(text) > 2 and bool(((text[:-2] == 0x3C) & (text[2:] == 0x3E) & np.isin(text[1:-1], [0x50, 0x53, 0x4D])).any())


@dataclass(frozen=True)
class Choice:
    """How texts are cut: plain: percent of texts that stay as they are; spm: percent of the others in that form."""

    seed: int = 1
    plain: int = 10
    spm: int = 20

    def of(self, doc_id: object, text: np.ndarray) -> tuple[int, str, int, int]:
        """Number of tokens, form, and the bytes at which prefix and middle end."""
        starts = tokens(text)
        n = len(starts)
        digits = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
        form = "plain" if not n or h3 % 100 >= 100 - self.plain or marked(text) else "spm" if h4 % 100 < self.spm else "psm"
        low, high = (int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        return n, form, low, high


def _values(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value, where Arrow keeps them."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in itertools.pairwise(ends.tolist()):
        yield data[a:b]


def arrange(docs: DataFrame, how: Choice = Choice()) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output_sha256, restored_sha256 (of the text read back from the output) and
    pieces (the output's piece table, in bytes) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _values(batch.column("text")), strict=True):
                n, form, low, high = how.of(doc_id, text)
                table = arranged(len(text), low, high, form)
                made = b"".join(stream(table, memoryview(text)))
                sizes = (None, None) if form == "plain" else (chars(text[:low]), chars(text[low:high]))
                rows.append((doc_id, n, form, *sizes, digest(table, memoryview(text)), digest(restored(made, form), memoryview(made)), [dict(zip(("buffer", "start", "end"), p, strict=True)) for p in table]))
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "pieces"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, pieces array<struct<buffer: int, start: long, end: long>>")


def _with_texts(docs: DataFrame, columns: list[str], of: Callable[[object, object, np.ndarray], tuple[str, list[Piece]]], form: str) -> DataFrame:
    """The columns of docs, with texts as `of` (of doc_id, form and text) says, and in the column form what it says first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            said = batch.column(form).to_pylist() if form in batch.schema.names else [None] * batch.num_rows
            got = [(f, b"".join(stream(table, memoryview(text))).decode("utf-8", "surrogatepass")) for d, f, text in zip(batch.column("doc_id").to_pylist(), said, _values(batch.column("text")), strict=True) for f, table in [of(d, f, text)]]
            new = {form: pa.array([f for f, _ in got], pa.string()), "text": pa.array([t for _, t in got], pa.string())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {form: "string", "text": "string"}
    return bounded(docs).select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def transformed(docs: DataFrame, how: Choice = Choice(), form: str = "form") -> DataFrame:
    """docs with their outputs in place of their texts, and the column form, whose name must be free."""
    if form in docs.columns:
        raise ValueError(f"there is a column {form}; name another")

    def of(doc_id, _, text):
        _, own, low, high = how.of(doc_id, text)
        return own, arranged(len(text), low, high, own)

    return _with_texts(docs, [*docs.columns, form], of, form)


def whole(made: DataFrame, form: str = "form") -> DataFrame:
    """Rows of transformed() with the texts that they were made from, without the column form."""
    return _with_texts(made, [c for c in made.columns if c != form], lambda _, own, text: (own, restored(bytes(text), own)), form)


def digests(docs: DataFrame) -> DataFrame:
    return arrange(docs).drop("pieces")

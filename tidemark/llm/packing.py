"""Packing of documents into sequences of a fixed length by minimum bin slack.

A document's ids (its text's, then the end id) are cut into full windows and a remainder. The remainders of a group of
documents form a multiset of lengths; each window takes the longest one left and then the multiset whose sum comes
closest to the capacity, found by subset-sum over bitsets (bit s: sum s can be reached) and read back with counts.

A group is what one task holds at a time (GROUP_TOKENS), so texts are not shuffled and memory doesn't grow with the
input; what a group could not fill well is carried on to the next. What a task has left over at its end (less than KEPT
windows) is not padded there: the pieces, without texts, are written out, and the left ones of all tasks are pooled in groups
of POOL_TOKENS and packed by the same method. So padding doesn't depend on the number of tasks; only the last window of a
pooled group has more than bin slack leaves.

Null text: empty, its document is the end id alone. Repeated rows, repeated and null ids are packed each row by itself; rows that
are equal have equal pieces in different places. Of multisets that come equally close the one with the longest pieces is taken.
Control strings of the tokenizer inside a text are ordinary text there, as its file's description advises.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import pieces, texts, written

GROUP_TOKENS = 2_000_000
POOL_TOKENS = 500_000
#: Windows' worth of pieces that are kept back while more may come.
KEPT = 32


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near to capacity as it can be; lengths: those there are, by length."""
    reach = [1]
    order: list[tuple[int, int]] = []
    for length in sorted((x for x in lengths if x <= capacity), reverse=True):
        left, part = min(lengths[length], capacity // length), 1
        while left:  # 1, 2, 4, ... of them at once: all counts can be reached in few shifts
            k = min(part, left)
            left, part = left - k, part * 2
            order.append((length, k))
            reach.append((reach[-1] | reach[-1] << length * k) & ((2 << capacity) - 1))
            if reach[-1] >> capacity & 1:
                break
        if reach[-1] >> capacity & 1:
            break
    taken: dict[int, int] = defaultdict(int)
    at = reach[-1].bit_length() - 1
    for (length, k), before in zip(reversed(order), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            taken[length] += k
            at -= length * k
    return dict(taken)


class Packer:
    """Windows from remainders; add() then windows(), which keeps back what fills no window while more may come."""

    def __init__(self, window: int):
        self.window, self.open, self.left = window, defaultdict(list), 0

    def add(self, length: int, piece: object) -> None:
        self.open[length].append(piece)
        self.left += length

    def windows(self, last: bool = False) -> Iterator[list[tuple[int, object]]]:
        while self.left and (last or self.left >= KEPT * self.window):
            lengths = {n: len(x) for n, x in self.open.items()}
            first = max(lengths)
            lengths[first] -= 1
            taken = fill({n: k for n, k in lengths.items() if k}, self.window - first)
            taken[first] = taken.get(first, 0) + 1
            out = []
            for n, k in sorted(taken.items(), reverse=True):
                out += [(n, self.open[n].pop()) for _ in range(k)]
                self.left -= n * k
                if not self.open[n]:
                    del self.open[n]
            yield out


FIELDS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _rows(sequences: Iterator[list[tuple[int, tuple]]], base: int) -> Iterator[list[tuple]]:
    """Rows (the piece, sequence_id, offset) of numbered sequences, some thousands at once."""
    rows: list[tuple] = []
    for k, members in enumerate(sequences):
        offset = 0
        for length, piece in members:
            rows.append((*piece, base + k, offset))
            offset += length
        if len(rows) >= 10_000:
            yield rows
            rows = []
    yield rows


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, more: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and with more, ids).

    sequence_id: the task's number in the upper bits (above bit 62: of a pooled group), so it is the same when a lost task runs again.
    """
    source = texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *FIELDS, *["ids"] * more]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in FIELDS) + ", ids array<long>" * more

    def table(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        """Of tuples doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset."""
        doc, *numbers, ids, sequence, offset = zip(*rows, strict=True) if rows else [()] * 8
        arrays = [pa.array(doc, doc_type), *(pa.array(c, pa.int64()) for c in (*numbers, sequence, offset))]
        if more:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, done = Packer(window), TaskContext.get().partitionId() << 32, 0
        own, tokens, full, doc_type = encoder(path), 0, [], None
        for batch in pieces(batches, 4 << 20):
            doc_type = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                tokens += len(ids)
                for start in range(0, len(ids), window):
                    part = ids[start : start + window].tobytes()
                    n = len(part) // 4
                    piece = (doc, start, n, zlib.crc32(part), len(ids), part if more else None)
                    if n == window:
                        full.append([(n, piece)])
                    else:
                        packer.add(n, piece)
            if tokens >= GROUP_TOKENS:
                filled = [*full, *packer.windows()]
                for rows in _rows(iter(filled), base + done):
                    yield table(rows, doc_type)
                done, tokens, full = done + len(filled), 0, []
        if doc_type is not None:
            filled = [*full, *packer.windows()]
            for rows in _rows(iter(filled), base + done):
                yield table(rows, doc_type)
            yield table([(*piece, None, None) for own in packer.open.values() for piece in own], doc_type)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, doc_type = Packer(window), 1 << 62 | TaskContext.get().partitionId() << 32, None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            ids = [np.array(x, "<u4").tobytes() for x in batch.column("ids").to_pylist()] if more else [None] * batch.num_rows
            for *piece, part in zip(*(batch.column(c).to_pylist() for c in ["doc_id", *FIELDS[:4]]), ids, strict=True):
                packer.add(piece[2], (*piece, part))
        if doc_type is not None:
            for rows in _rows(packer.windows(last=True), base):
                yield table(rows, doc_type)

    found = written(source.mapInArrow(first, schema), "packed")
    left = found.where("sequence_id is null")
    groups = -(-(left.agg(F.sum("length")).first()[0] or 0) // POOL_TOKENS)
    return found.where("sequence_id is not null").union(left.repartition(max(1, groups)).mapInArrow(pooled, schema))

"""Removal of passages that were met before, with a compressed full-text index for each shard.

Every window of `window` words has a representative, the smallest hash among its k-word grams, so that equal windows have
equal ones, and neighbouring windows mostly share theirs: a run. Representatives are counted by exchanging packed blocks;
runs whose representative is found once only cannot repeat and go no further. The others go, as words, to the shard of
their representative; equal runs of one task are sent once, its later ones being repeats already.

A representative that a batch holds twice is known to repeat: its runs go on at once and one row tells the others, so that
no block holds more than one row of it for each batch. Runs of representatives with more than their share of all runs (a
passage that many documents have, each with its own words around it) would meet in one shard. They are counted first, by
summaries of fixed size, and go on window by window, each to the shard of its own words; equal windows are compared whole.

A shard builds an FM-index over its distinct runs in order of their first place (suffixes sorted to the depth of a window,
a wavelet matrix over the Burrows-Wheeler transform, bit vectors for the borders of intervals) and streams the runs through
it by backward search. Matching statistics are capped at the window, so at every place the interval of the window that
begins there is known; the smallest place in it tells whether the window starts earlier. Nothing is judged by hash alone.

A row is known by its id and, where ids repeat, by its text: rows with one id and different texts are different documents, in
order of a hash of their texts after those with smaller ids; rows that are equal in both count as one document, which
doesn't remove itself. Rows with a null id have no place in the order: they stay as they are and remove nothing. Null text: no
words. Texts shorter than a window stay as they are. Texts are whole, and there is no cap on repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, ids_repeat, ngram_hashes, partitions, pieces, texts, unused, word_hashes, written

GRAM = 8
WINDOW = 20
#: Counters in a summary of representatives, and the least runs of a hot one.
COUNTERS = 1 << 16
HOT = 512
#: The second part of the key of rows without an id; that of others is odd or 0.
NOBODY = 2


class Bits:
    """A bit vector with rank in constant time and the places of its ones."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol before a place, by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[Bits, int]] = []
        for bit in range(max(1, int(symbols.max(initial=1)).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        base = np.zeros_like(i)
        for bit, (ones, zeros) in zip(range(len(self.levels) - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> bit & 1).astype(bool)
            a, b = ones.rank(base), ones.rank(i)
            base, i = np.where(one, zeros + a, base - a), np.where(one, zeros + b, i - b)
        return i - base


def _paired(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (rank here, rank shift places on): orders twice the depth, or less where they overlap."""
    on = np.zeros_like(rank)
    on[:-shift] = rank[shift:]
    return np.unique(rank * (int(rank.max(initial=0)) + 1) + on, return_inverse=True)[1].astype(np.int64)


class FmIndex:
    """Index of a text of symbols (0 between parts) for patterns of up to `window` symbols."""

    def __init__(self, text: np.ndarray, window: int = WINDOW):
        n = len(text)
        self.window = window
        rank, depth = text.astype(np.int64), 1
        while depth * 2 <= window - 1:
            rank, depth = _paired(rank, depth), depth * 2
        shorter = _paired(rank, window - 1 - depth) if window - 1 > depth else rank
        full = _paired(rank, window - depth)
        order = np.argsort(full, kind="stable")
        self.bwt = WaveletMatrix(text[order - 1])
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])
        new = lambda r: np.concatenate([[True], r[order][1:] != r[order][:-1]])
        edge, border = np.flatnonzero(new(full)), new(shorter)
        self.classes, self.borders = Bits(new(full)), Bits(border)
        self.border_at = np.append(np.flatnonzero(border), n)
        #: The first place in the text of each class of windows.
        self.first = np.minimum.reduceat(order, edge)

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the pattern without its last symbol."""
        k = self.borders.rank(lo + 1)
        return self.border_at[k - 1], self.border_at[k]

    def extended(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of the pattern with symbol before it."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.below[symbol] + both[: len(lo)], self.below[symbol] + both[len(lo) :]

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        return self.first[self.classes.rank(lo + 1) - 1]


def seen_before(parts: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each part, in order: whether it also starts earlier in the parts. With where each part's flags begin."""
    number: dict[bytes, int] = {}
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.zeros(int((size + 1).sum()), dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    flat = np.fromiter((number.setdefault(w, len(number) + 1) for p in parts for w in p), np.int64, int(size.sum()))
    text[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(flat))] = flat
    index = FmIndex(text, window)
    count = np.maximum(size - window + 1, 0)
    offset = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=bool)
    lo, hi = np.zeros(len(parts), dtype=np.int64), np.full(len(parts), len(text), dtype=np.int64)
    for k in range(int(size.max(initial=0))):  # all parts side by side, from their ends
        live = np.flatnonzero(size > k)
        at = begin[live] + size[live] - 1 - k
        a, b = (lo[live], hi[live]) if k < window else index.shortened(lo[live])
        lo[live], hi[live] = index.extended(text[at], a, b)
        if k >= window - 1:
            out[offset[live] + size[live] - 1 - k] = index.earliest(lo[live]) < at
    return out, offset


def _runs(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representative, first window and number of windows of each run."""
    grams = ngram_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[start]], start, np.diff(np.append(start, len(at)))


RUN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("twin", "<i8"), ("start", "<i4"), ("n", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("twin", "<i8"), ("start", "<i8")])
SPAN = np.dtype([("start", "<i4"), ("n", "<i4")])


def _by_block(rows: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(rows):
        return
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    for a, b in zip(edge, np.append(edge[1:], len(block)), strict=True):
        yield int(block[a]), rows[a:b]


def _by_doc(rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["twin"], rows["doc"]))]
    edge = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["twin"][1:] != rows["twin"][:-1])]))
    for a, b in zip(edge, np.append(edge[1:], len(rows)), strict=True):
        yield int(rows["doc"][a]), int(rows["twin"][a]), rows[a:b]


def _columns(rows: np.ndarray) -> bytes:
    """A table's columns one after another, which pack better than rows."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _table(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.empty(n, kind)
    for c in kind.names:
        out[c] = np.frombuffer(data, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _summed(h: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the values in h, at most `most` of them (Misra and Gries): each too low by no more than the sum of all over `most`."""
    value, at = np.unique(h, return_inverse=True)
    count = np.bincount(at, weights=n, minlength=len(value)).astype(np.int64)
    if len(value) > most:
        count -= np.partition(count, len(count) - most - 1)[len(count) - most - 1]
        value, count = value[count > 0], count[count > 0]
    return value, count


def hot_representatives(source: DataFrame, window: int, gram: int, least: int = HOT, counters: int = COUNTERS) -> np.ndarray:
    """Sorted representatives with many runs: all with more than max(least, runs / counters) + runs / counters of them, and none
    with fewer than max(least, runs / counters); so there are at most `counters`, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in pieces(batches, 4 << 20):
            own = np.concatenate([_runs(w, window, gram)[0] for w in word_hashes(batch.column("text").to_pylist())])
            total += len(own)
            h, n = _summed(np.concatenate([h, own]), np.concatenate([n, np.ones(len(own), np.int64)]), counters)
        more = n > 1
        yield _batch(("h", [None, *h[more].view(np.int64).tolist()], pa.int64()), ("n", [total, *n[more].tolist()], pa.int64()))

    counted = source.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("h").isNull() | (F.col("n") >= least))
    counted = written(counted, "substring-hot")
    total = (counted.where("h is null").first() or {"n": 0})["n"]
    found = counted.where(F.col("h").isNotNull() & (F.col("n") >= max(least, total // counters))).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64))


def _batch(*columns: tuple[str, list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in columns], [n for n, _, _ in columns])


def keyed(docs: DataFrame, doc: str, twin: str) -> DataFrame:
    """docs and, in two columns that are never null, what a row is known by: its id, and a hash of its text where ids repeat (0
    where none does; NOBODY for rows without an id). Ids alone are counted for this, texts aren't moved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own: Column = F.xxhash64(text).bitwiseOR(F.lit(1)) if ids_repeat(docs) else F.lit(0).cast("long")
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), twin: F.when(F.col("doc_id").isNull(), F.lit(NOBODY).cast("long")).otherwise(own)})


def repeated_spans(base: DataFrame, doc: str, twin: str, window: int = WINDOW, gram: int = GRAM, least: int = HOT) -> DataFrame:
    """doc, twin, removed (packed SPANs of words): rows for the documents of a keyed table that have windows that also start earlier."""
    columns = base.columns
    source = base.where(F.col(twin) != NOBODY).select(F.col(doc).alias("doc"), F.col(twin).alias("twin"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = max(partitions(base.sparkSession), 2 * source.rdd.getNumPartitions())  # a block's size does not grow with the input
    shards = 4 * blocks  # they hold words, not numbers
    hot = set(hot_representatives(source, window, gram, least).tolist())

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            rows = []
            for d, t, words in zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), word_hashes(batch.column("text").to_pylist()), strict=True):
                h, start, n = _runs(words, window, gram)
                own = np.empty(len(h), RUN)
                own["h"], own["doc"], own["twin"], own["start"], own["n"] = h, d, t, start, n
                rows.append(own)
            rows = np.concatenate(rows)
            rows = rows[np.argsort(rows["h"], kind="stable")]
            new = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])[: len(rows)]
            alone = new & np.append(new[1:], True)[: len(rows)]
            # of those that repeat here, one row without windows goes to the block
            asked = np.concatenate([rows[alone], rows[new & ~alone]])
            asked["n"][int(alone.sum()) :] = 0
            found = list(_by_block(asked, (asked["h"] % np.uint64(blocks)).astype(np.int64)))
            yield _batch(("block", [b for b, _ in found], pa.int32()), ("doc", [None] * len(found), pa.int64()), ("twin", [None] * len(found), pa.int64()), ("data", [_columns(r) for _, r in found], pa.binary()))
            known = list(_by_doc(rows[~alone]))
            yield _batch(("block", [d % blocks for d, _, _ in known], pa.int32()), ("doc", [d for d, _, _ in known], pa.int64()), ("twin", [t for _, t, _ in known], pa.int64()), ("data", [_columns(r) for _, _, r in known], pa.binary()))

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "twin", "data")), strict=True))
            passed = [x for x in own if x[0] is not None]
            if passed:
                yield _batch(("doc", [d for d, _, _ in passed], pa.int64()), ("twin", [t for _, t, _ in passed], pa.int64()), ("runs", [x for _, _, x in passed], pa.binary()))
            rows += [_table(x, RUN) for d, _, x in own if d is None]
        if not rows:
            return
        rows = np.concatenate(rows)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        new = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
        more = ~(new & np.append(new[1:], True))
        found = list(_by_doc(rows[more & (rows["n"] > 0)]))
        for k in range(0, len(found), 5000):
            part = found[k : k + 5000]
            yield _batch(("doc", [d for d, _, _ in part], pa.int64()), ("twin", [t for _, t, _ in part], pa.int64()), ("runs", [_columns(r) for _, _, r in part], pa.binary()))

    def settled(by: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple[str, list, pa.DataType]]:
        return [("doc", [d for d, _ in by], pa.int64()), ("twin", [t for _, t in by], pa.int64()), ("data", [_columns(np.array(x, dtype=SPAN)) for x in by.values()], pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int, int, int]] = {}
        later: dict[tuple[int, int], list[tuple[int, int]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            single: dict[bytes, tuple[int, int, int]] = {}
            for part, (h, *place) in first.items():
                if h not in hot:
                    by.setdefault(h % shards, []).append((part, tuple(place)))
                    continue
                words = part.split(b" ")
                for i in range(len(words) - window + 1):
                    own, at = b" ".join(words[i : i + window]), (*place[:2], place[2] + i)
                    before = single.setdefault(own, at)
                    if before != at:
                        single[own], drop = sorted([before, at])
                        later.setdefault(drop[:2], []).append((drop[2], window))
            for own, at in single.items():  # blocks of whole windows have negative numbers until they are sent
                by.setdefault(-1 - xxhash.xxh3_64_intdigest(own) % shards, []).append((own, at))
            if by:
                places = [_columns(np.array([at for _, at in own], dtype=PLACE)) for own in by.values()]
                yield _batch(("block", [b if b >= 0 else -1 - b for b in by], pa.int32()), ("doc", [None] * len(by), pa.int64()), ("twin", [None] * len(by), pa.int64()), ("single", [b < 0 for b in by], pa.bool_()), ("places", places, pa.binary()), ("data", [b"\n".join([x for x, _ in own]) for own in by.values()], pa.binary()))
            if later:
                n = len(later)
                yield _batch(("block", [d % shards for d, _ in later], pa.int32()), *settled(later)[:2], ("single", [False] * n, pa.bool_()), ("places", [None] * n, pa.binary()), settled(later)[2])
            first.clear()
            later.clear()

        for batch in pieces(batches):
            for d, t, text, runs in zip(*(batch.column(c).to_pylist() for c in (doc, twin, "text", known)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                for run in sorted(x for r in runs for x in _table(r, RUN)[["start", "n", "h"]].tolist()):
                    start, n, h = run
                    part, at = b" ".join(words[start : start + n - 1 + window]), (d, t, start)
                    before = first.get(part)
                    if before is None:
                        first[part] = (h, *at)
                        held += len(part) * (n if h in hot else 1)
                    elif before[1:] != at:
                        keep, drop = sorted([before[1:], at])
                        first[part] = (before[0], *keep)
                        later.setdefault(drop[:2], []).append((drop[2], n - 1 + window))
                if held >= 8 << 20:
                    yield from flush()
                    held = 0
        yield from flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, list[tuple[int, int, int]]] = {}
        whole: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
            own = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "twin", "single", "places", "data")), strict=True))
            passed = [x for x in own if x[0] is not None]
            if passed:  # spans that are settled
                yield _batch(("doc", [x[0] for x in passed], pa.int64()), ("twin", [x[1] for x in passed], pa.int64()), ("removed", [x[4] for x in passed], pa.binary()))
            for d, _, single, where, data in own:
                if d is not None:
                    continue
                for part, place in zip(data.split(b"\n"), _table(where, PLACE).tolist(), strict=True):
                    if not single:
                        places.setdefault(part, []).append(place)
                    elif (before := whole.setdefault(part, place)) != place:
                        whole[part], drop = sorted([before, place])
                        gone.setdefault(drop[:2], []).append((drop[2], window))
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in settled(gone)], ["doc", "twin", "removed"])
        if not places:
            return
        order = sorted((min(p), part) for part, p in places.items())
        split = [part.split(b" ") for _, part in order]
        flags, offset = seen_before(split, window)
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        bound = np.append(offset, len(flags)).tolist()
        for (first, part), words, a, b in zip(order, split, bound, bound[1:], strict=False):
            for place in set(places[part]) - {first}:
                out.setdefault(place[:2], []).append((place[2], len(words)))
            own = flags[a:b]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                out.setdefault(first[:2], []).extend((first[2] + int(s), int(e - s) - 1 + window) for s, e in zip(edge[::2], edge[1::2], strict=True))
        keys = list(out)
        for k in range(0, len(keys), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in settled({x: out[x] for x in keys[k : k + 5000]})], ["doc", "twin", "removed"])

    known = unused(columns, "runs")
    runs = source.mapInArrow(represent, "block int, doc long, twin long, data binary").repartition(blocks, "block").mapInArrow(twice, "doc long, twin long, runs binary")
    candidates = runs.groupBy(F.col("doc").alias(doc), F.col("twin").alias(twin)).agg(F.collect_list("runs").alias(known))
    # all columns go along, so that the exchange of this join is the one of the join with the spans that are found
    parts = base.join(candidates, [doc, twin]).select(*columns, known).mapInArrow(cut, "block int, doc long, twin long, single boolean, places binary, data binary")
    return parts.repartition(shards, "block").mapInArrow(search, "doc long, twin long, removed binary")


def _kept(text: str, removed: list[bytes] | None) -> tuple[list[bytes], np.ndarray]:
    words = text.encode("utf-8", "surrogatepass").split()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for r in removed or []:
        spans = _table(r, SPAN)
        np.add.at(edge, spans["start"], 1)
        np.add.at(edge, spans["start"] + spans["n"], -1)
    return words, np.cumsum(edge)[:-1] == 0


def _with_removed(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """docs with a column of packed spans, and that column's name. Rows without an id have no spans and stay out of the joins."""
    columns = docs.columns
    doc, twin, removed = (unused(columns, c) for c in ("doc", "twin", "removed"))
    base = keyed(bounded(docs), doc, twin)
    named = base.where(F.col("doc_id").isNotNull())
    spans = repeated_spans(named, doc, twin, window).groupBy(F.col("doc").alias(doc), F.col("twin").alias(twin)).agg(F.collect_list("removed").alias(removed))
    nobody = base.where(F.col("doc_id").isNull()).select(*columns, F.lit(None).cast("array<binary>").alias(removed))
    return named.join(spans, [doc, twin], "left").select(*columns, removed).union(nobody), removed


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, gone, sha = [], [], []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                words, keep = _kept(text, removed)
                n.append(len(words))
                gone.append(int(len(words) - keep.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if gone[-1] else words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined, _ = _with_removed(texts(docs), window)
    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of docs, with the repeated words taken out of text. Texts without any stay as they are, white space included;
    in the others kept words are joined by one space. A document of which nothing is left goes."""
    columns = docs.columns
    joined, spans = _with_removed(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, stays = [], []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
                if removed:
                    words, keep = _kept(text or "", removed)
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    stays.append(bool(left))
                    text = b" ".join(left).decode("utf-8", "surrogatepass")
                else:
                    stays.append(True)
                out.append(text)
            kept = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))
            yield kept.select(columns).filter(pa.array(stays, pa.bool_()))

    kept = joined.mapInArrow(run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else kept

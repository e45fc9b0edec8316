"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds
every token in a text. A piece is then encoded from left to right: take the longest token, keep it if it can stand
beside the token before (the pair, encoded alone, stays as it is), else try the next shorter one, else step back.
Compatibility of neighbours is memoised. The result is what the merges give, in time linear in the text: the longest
match at each place of a piece is found in one pass over it, and no place that led nowhere is tried again.

Nulls count as empty text: no tokens. Repeated rows and ties have each their own result row. Texts are whole; a long one is
worked on in parts that end where no piece does, a piece without white space in it always as one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, span_hashes, texts

#: Stands between pieces in the searched string; no byte maps to it.
GAP = "Ā"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
EDGE = regex.compile(r"\S(?=\s)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Merges:
    """Encodes single pieces; ranks: token bytes to id, the id being the order of the merge."""

    MEMO = 1 << 20
    #: Longer pieces are encoded one by one, the others side by side.
    LONG = 256

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.ranks, self.bytes = ranks, [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.length = np.array([len(t) for t in self.bytes], dtype=np.int64)
        #: For each token the two it was merged from; a single byte is its own half.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        usable = set()
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self._halves(token, rank)
                if len(halves) != 2:  # no merges lead to it: it only ever stands for a whole piece
                    continue
                self.left[rank], self.right[rank] = halves
                self.merged[halves[0], halves[1]] = rank
            usable.add(token)
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = np.full(size, -1, dtype=np.int64)
        for token in usable:
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in usable:
                    self.shorter[ranks[token]] = ranks[token[:n]]
                    break
        self.memo_key = np.full(self.MEMO, -1, dtype=np.int64)
        self.memo_value = np.zeros(self.MEMO, dtype=bool)
        self.pairs: dict[int, bool] = {}
        self.lengths, self.shorters = self.length.tolist(), self.shorter.tolist()

    def _halves(self, token: bytes, below: int) -> list[int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are: no merge across their border comes before both are whole."""
        limit = len(self.bytes) + 1
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        slot = ((key * -7046029254386353131) >> 44) & (self.MEMO - 1)
        out, known = self.memo_value[slot], self.memo_key[slot] == key
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            value = np.fromiter((self.stays(k >> 20, k & 0xFFFFF) for k in new.tolist()), bool, len(new))
            out[~known] = value[back]
            at = ((new * -7046029254386353131) >> 44) & (self.MEMO - 1)
            self.memo_key[at], self.memo_value[at] = new, value
            # two new keys may share a slot: the key that stayed there must have its own value
            self.memo_value[at] = np.where(self.memo_key[at] == new, value, self.memo_value[at])
            clash = self.memo_key[at] != new
            self.memo_key[at[clash]] = -1
        return out

    def _greedy(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begins and tokens of the longest matches, each taken where the one before ends."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        return found[:, 0] - self.length[found[:, 1]] + 1, found[:, 1]

    def _longest(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begins and tokens of the longest match at every place: all matches in one pass, in order of their ends, the last one of a begin stays."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        at = np.full(len(text), -1, dtype=np.int64)
        at[found[:, 0] - self.length[found[:, 1]] + 1] = found[:, 1]
        where = np.flatnonzero(at >= 0)
        return where, at[where]

    def _encode_long(self, part: bytes) -> list[int]:
        """The ids of one long piece, token by token."""
        text = part.decode("latin-1")
        longest = np.zeros(len(text), dtype=np.int64)
        at, t = self._longest(text)
        longest[at] = t
        longest, dead, taken, memo = longest.tolist(), bytearray(len(text) + 1), [], self.pairs
        length, shorter, pos, n = self.lengths, self.shorters, 0, len(text)
        token = longest[0]
        while pos < n:
            to, good = pos + length[token], True
            if dead[to]:
                good = False
            elif taken:
                pair = taken[-1] << 20 | token
                good = memo.get(pair)
                if good is None:
                    if len(memo) > self.MEMO:
                        memo.clear()
                    good = memo[pair] = self.stays(taken[-1], token)
            if good:
                taken.append(token)
                pos = to
                if pos < n:
                    token = longest[pos]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[pos] = 1
                token = taken.pop()
                pos -= length[token]
        return taken

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each part has. Parts are not empty."""
        n = len(parts)
        counts = np.ones(n, dtype=np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in parts), np.int64, n)
        long = {i: self._encode_long(parts[i]) for i in np.flatnonzero(whole < 0).tolist() if len(parts[i]) > self.LONG}
        counts[list(long)] = list(map(len, long.values()))
        whole[list(long)] = 0
        open_ = np.flatnonzero(whole < 0)
        if not len(open_) and not long:
            return whole, counts
        size = np.fromiter((len(parts[i]) for i in open_), np.int64, len(open_))
        begin = np.cumsum(size + 1) - size - 1
        text = GAP.join(parts[i].decode("latin-1") for i in open_)
        at, t = self._greedy(text) if text else (np.empty(0, np.int64),) * 2
        longest = np.full(len(text) + 1, -1, dtype=np.int64)  # what the greedy walk met; other places when they are needed
        longest[at] = t
        free = np.ones(len(text) + 2, dtype=bool)
        taken = np.zeros(len(text) + 1, dtype=np.int64)  # the k-th token of a piece, at the piece's begin + k
        pos, end, depth = begin.copy(), begin + size, np.zeros(len(open_), dtype=np.int64)
        last, token = np.full(len(open_), -1, dtype=np.int64), longest[begin]
        live = np.arange(len(open_))
        while len(live):
            p, t, before = pos[live], token[live], last[live]
            to = p + self.length[t]
            good = free[to]
            pair = good & (before >= 0)
            if pair.any():
                good[pair] = self._compatible(before[pair], t[pair])
            took = live[good]
            taken[begin[took] + depth[took]] = t[good]
            depth[took] += 1
            last[took], pos[took] = t[good], to[good]
            on = took[pos[took] < end[took]]
            new = pos[on]
            lacking = longest[new] < 0
            if lacking.any():
                rest = [text[a:b] for a, b in zip(new[lacking].tolist(), end[on[lacking]].tolist(), strict=True)]
                at, met = self._longest(GAP.join(rest))
                sizes = np.fromiter(map(len, rest), np.int64, len(rest))
                row = np.repeat(np.arange(len(rest)), sizes + 1)
                longest[at + (new[lacking] - np.cumsum(sizes + 1) + sizes + 1)[row[at]]] = met
            token[on] = longest[new]
            bad, tb = live[~good], t[~good]
            less = self.shorter[tb]
            token[bad[less >= 0]] = less[less >= 0]
            back = bad[less < 0]
            if len(back):
                free[pos[back]] = False
                token[back] = last[back]
                depth[back] -= 1
                pos[back] -= self.length[last[back]]
                last[back] = np.where(depth[back] > 0, taken[begin[back] + np.maximum(depth[back] - 1, 0)], -1)
            live = live[pos[live] < end[live]]
        counts[open_] = depth
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        ids = np.empty(int(counts.sum()), dtype=np.int64)
        ids[first[whole >= 0]] = whole[whole >= 0]
        step = np.arange(int(depth.sum())) - np.repeat(np.cumsum(depth) - depth, depth)
        ids[np.repeat(first[open_], depth) + step] = taken[np.repeat(begin, depth) + step]
        for i, own in long.items():
            ids[first[i] : first[i] + len(own)] = own
        return ids, counts


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


class Known:
    """Pieces that were met, by a hash of their code points: an open table in arrays, asked for many pieces at once. A piece
    found is compared with the one kept, code point by code point."""

    SLOTS = 1 << 21

    def __init__(self):
        self.key, self.number = np.zeros(self.SLOTS, dtype=np.uint64), np.zeros(self.SLOTS, dtype=np.int32)
        self.n, self.used = 0, 0
        self.begin, self.size, self.points = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype=np.uint32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1: not there."""
        out, open_, slot = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), self._slots(h)
        while len(open_):
            there = self.key[slot]
            same = there == h[open_]
            out[open_[same]] = self.number[slot[same]]
            on = ~same & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def equal(self, number: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the numbered pieces are those of the text's points that begin there."""
        good = self.size[number] == size
        n, ends = np.where(good, size, 0), np.cumsum(np.where(good, size, 0))
        step = np.arange(int(ends[-1]) if len(ends) else 0)
        off = np.repeat(begin - ends + n, n) + step
        on = np.repeat(self.begin[number] - ends + n, n) + step
        wrong = np.flatnonzero(points[off] != self.points[on])
        good[np.searchsorted(ends, wrong, side="right")] = False
        return good

    def add(self, h: np.ndarray | None, parts: list[str]) -> np.ndarray:
        """Keeps new pieces; gives their numbers. Without hashes they can't be found again."""
        data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        number = self.n + np.arange(len(parts))
        self.begin, self.size = grown(self.begin, self.n + len(parts)), grown(self.size, self.n + len(parts))
        self.points = grown(self.points, self.used + len(data))
        self.begin[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.points[self.used : self.used + len(data)] = data
        self.n, self.used = self.n + len(parts), self.used + len(data)
        if h is not None:
            open_, slot = np.arange(len(h)), self._slots(h)
            while len(open_):
                free = self.key[slot] == 0
                self.key[slot[free]] = h[open_[free]]
                won = free & (self.key[slot] == h[open_])
                self.number[slot[won]] = number[open_[won]]
                open_, slot = open_[~won], (slot[~won] + 1) & (self.SLOTS - 1)
        return number


def grown(data: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n at least."""
    return data if n <= len(data) else np.concatenate([data, np.zeros(max(n, 2 * len(data)) - len(data), dtype=data.dtype)])


class Encoder:
    """Texts to ids: cuts texts by the pattern of the rank files and keeps the ids of pieces that it has met."""

    LIMIT = 700_000
    #: Code points of text that are worked on at once, and of all pieces kept.
    STEP = 1 << 18
    KEPT = 1 << 24

    def __init__(self, path: str):
        self.merges, self.classes = Merges(read_ranks(path)), _classes()
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self.ids, self.first, self.count, self.used = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0

    def cuts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin in joined texts; begins: where the texts do. The same cuts as public_tokenizers.PATTERN makes."""
        kind = self.classes[points]
        head = np.zeros(len(points) + 1, dtype=bool)
        head[begins] = True
        head[-1] = True
        run = head[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        cut = run.copy()
        word = np.flatnonzero(run & (kind != SPACE) & ~head[:-1])
        word = word[kind[word - 1] == SPACE]
        cut[word - 1] = True  # a blank goes with what follows; another last white space stands alone
        cut[word[points[word - 1] == 0x20]] = False
        quote = np.flatnonzero((points == 0x27) & run & cut)
        quote = quote[quote + 1 < len(points)]
        quote = quote[run[quote + 1] & (kind[quote + 1] == LETTER) & ~head[quote + 1]]
        if len(quote):
            c1 = points[quote + 1]
            c2 = np.where(head[quote + 2], 0, points[np.minimum(quote + 2, len(points) - 1)])
            one = np.isin(c1, [ord(x) for x in "stmd"])
            two = (c1 == ord("r")) & (c2 == ord("e")) | (c1 == ord("v")) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
            cut[quote[one | two] + 1] = False
            for q, k in ((quote[one], 2), (quote[two], 3)):
                q = q[q + k < len(points)]
                cut[q + k] = True
        return np.flatnonzero(cut)

    def _learn(self, h: np.ndarray | None, new: list[str]) -> np.ndarray:
        ids, counts = self.merges.encode([p.encode("utf-8", "surrogatepass") for p in new])
        number = self.known.add(h, new)
        self.first, self.count, self.ids = grown(self.first, self.known.n), grown(self.count, self.known.n), grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[number], self.count[number] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        return number

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        """The ids (unsigned 32-bit) of each text."""
        size, group = 0, []
        for text in batch:
            if len(text) > 2 * self.STEP:
                yield from self._encode(group)
                size, group = 0, []
                yield np.concatenate([next(self._encode([part])) for part in self._parts(text)])
                continue
            group.append(text)
            size += len(text)
            if size >= self.STEP:
                yield from self._encode(group)
                size, group = 0, []
        yield from self._encode(group)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut where white space follows something else: no piece of the pattern goes on there."""
        at = 0
        while at < len(text):
            cut = EDGE.search(text, min(at + self.STEP, len(text)))
            to = cut.end() if cut else len(text)
            yield text[at:to]
            at = to

    def _encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        if self.known.n > self.LIMIT or self.known.used > self.KEPT:
            self._clear()
        joined = "".join(batch)
        ends = np.cumsum(np.fromiter(map(len, batch), np.int64, len(batch)))
        if not joined:
            yield from (np.empty(0, dtype=np.uint32) for _ in batch)
            return
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = self.cuts(points, np.concatenate([[0], ends[:-1][ends[:-1] < len(joined)]]))
        bound = np.append(begin, len(points))
        size = np.diff(bound)
        h = span_hashes(points, begin, bound[1:])
        at = self.known.find(h)
        if (at < 0).any():
            lacking = np.flatnonzero(at < 0)
            new, where = np.unique(h[lacking], return_index=True)
            self._learn(new, [joined[bound[i] : bound[i + 1]] for i in lacking[where].tolist()])
            at[lacking] = self.known.find(h[lacking])
        other = np.flatnonzero(~self.known.equal(at, points, begin, size)).tolist()
        if other:  # another piece has their hash
            at[other] = self._learn(None, [joined[bound[i] : bound[i + 1]] for i in other])
        counts = self.count[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.first[at] - upto[:-1], counts) + np.arange(int(upto[-1]))]
        done = 0
        for k in upto[np.searchsorted(begin, ends)].tolist():
            yield ids[done:k]
            done = k


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = list(encoder(path).encode(batch.column("text").to_pylist()))
            values = pa.array(np.concatenate(ids).astype(np.int64), pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes (binary) from doc_id, ids. A null array gives no bytes; an id that the file lacks fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = encoder(path).merges.bytes
            out = [b"".join([token[i] for i in ids or []]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and decode() give, without moving ids between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        token, number = own.merges.bytes, [str(i) for i in range(len(own.merges.bytes))]
        for batch in pieces(batches):
            n, a, b = [], [], []
            for ids in own.encode(batch.column("text").to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(b"".join([token[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

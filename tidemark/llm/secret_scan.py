"""Secrets in texts, also in what is encoded inside them.

A worklist holds layers of a text: the text itself first, then what its encoded parts decode to. Each layer is scanned for
every kind; URL escapes (%u too), Unicode, byte, quote and HTML escapes, base64 and compressed data (gzip, zlib with any header, bzip2, xz) are unwrapped
until nothing new comes (a layer met before, with the same places in the original, ends its branch). Bytes are looked through for compressed
data and read as UTF-8 or UTF-16, whatever they were written in. Deflated data without a header can't be told from others and are left. Base64 is read at each of its four alignments, so that
letters, '/', '-' or '_' before it do no harm, by line and with wrapped lines as one; compressed data are found anywhere in what
it decodes to, at any depth and any ratio. A layer knows, run by run, where in the original text its characters came from, so what
is found in it is given as a span of the original. Matches of the text itself are kept as they are.

Memory: layers are unwrapped depth first, one branch at a time, and what decompression gives is scanned in windows of WINDOW bytes
that overlap by OVERLAP, so that a branch holds a window for each of its depths and never all that a small text inflates to. Windows
met before are not scanned again. A match longer than OVERLAP within decompressed data is given by what a window shows of it; a
base64 run of more than WINDOW characters inside compressed data is read window by window.

Null text: empty. Null ids, repeated ids and repeated rows: each row by itself. Spans are in code points, end exclusive, each once;
of equal starts the order is that of kinds, then ends.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, texts

#: Kinds, their patterns, the group that counts and its least length. Fixed values.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|%u([0-9A-Fa-f]{4})|&#([0-9]{1,7});")
#: Runs that bytes written as URL escapes, or in a string literal, can stand in, and the bytes of such a run.
URL_RUN = re.compile(r"(?<![!-~])(?:[!-$&-~]|%(?![0-9A-Fa-f]{2}))*+%[0-9A-Fa-f]{2}[!-~]*+")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|()(.)", re.DOTALL)
LITERAL_RUN = re.compile(r"(?:[\x20-\[\]-~]|\\[!-~])++")
LITERAL_BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\([abfnrtv0'"\\])|(.)""")
QUOTED = re.compile(r"""\\([\\'"/])""")
PLAIN_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "'": 39, '"': 34, "\\": 92}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK = r"[\x20\t]*(?:\r\n|\n|\r|(?:\\r)?\\n)[\x20\t>]*"
BREAKS = re.compile(BREAK)
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
#: Where compressed data begin (zlib: two bytes that 31 divides, no preset dictionary), and what shows that bytes that are not UTF-8 have text.
ZLIB = {bytes((a, b)) for a in range(0x08, 0x88, 0x10) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 0x20}
PACKED = re.compile(b"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|" + b"|".join(sorted(map(re.escape, ZLIB))))
STRETCH = re.compile(rb"[\t\r\n\x20-\x7e]{8,}")
#: Bytes of decompressed data that are scanned at once, how many of them the next window repeats, and how many go into a step.
WINDOW = 1 << 22
OVERLAP = 1 << 16
STEP = 1 << 16
#: What a base64 run decodes to stands in its place in the text up to this length; more is scanned beside it.
INLINE = 1 << 17
FOLDED = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches in one layer, leftmost and not overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        if FOLDED.search(text):
            found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """A text, and where its characters come from: runs by start. A run with end -1 is a copy that begins at `begin` in the original,
    each character of another stands for all of begin to end."""

    text: str
    starts: list[int] = field(default_factory=lambda: [0])
    begins: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [-1])

    def run(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = self.run(start), self.run(end - 1)
        a = self.begins[i] + (start - self.starts[i] if self.ends[i] < 0 else 0)
        return a, self.ends[j] if self.ends[j] >= 0 else self.begins[j] + end - self.starts[j]

    def copied(self, start: int, end: int) -> bool:
        return all(x < 0 for x in self.ends[self.run(start) : self.run(end - 1) + 1])

    def key(self) -> bytes:
        own = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        own.update(repr((self.starts, self.begins, self.ends)).encode())
        return own.digest()


class Rewritten:
    """A layer with some of its parts replaced, built from left to right."""

    def __init__(self, layer: Layer):
        self.layer, self.at, self.size = layer, 0, 0
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []

    def _copy(self, end: int) -> None:
        own, at = self.layer, self.at
        if at >= end:
            return
        for k in range(own.run(at), own.run(end - 1) + 1):
            s = max(at, own.starts[k])
            self._run(self.size + s - at, own.begins[k] + (s - own.starts[k] if own.ends[k] < 0 else 0), own.ends[k])
        self.parts.append(own.text[at:end])
        self.size, self.at = self.size + end - at, end

    def _run(self, *values: int) -> None:
        for column, v in zip((self.starts, self.begins, self.ends), values, strict=True):
            column.append(v)

    def replace(self, start: int, end: int, out: str) -> None:
        self._copy(start)
        self._run(self.size, *self.layer.span(start, end))
        self.parts.append(out)
        self.size, self.at = self.size + len(out), end

    def made(self) -> Layer | None:
        """The new layer; none if nothing was replaced."""
        if not self.parts:
            return None
        self._copy(len(self.layer.text))
        return Layer("".join(self.parts), self.starts, self.begins, self.ends)


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], str | None]) -> Layer | None:
    """The layer with each match of pattern replaced by what it decodes to (none: left as it is)."""
    new = Rewritten(layer)
    for m in pattern.finditer(layer.text):
        out = decode(m)
        if out:
            new.replace(m.start(), m.end(), out)
    return new.made()


def _text(data: bytes) -> str | None:
    """UTF-16 where every other byte is mostly 0 and those between hardly are, else UTF-8 with whatever characters; other bytes, where they have a stretch of text."""
    if b"\0" in data:
        even, odd = data[::2].count(0), data[1::2].count(0)
        for kind, zeros, others in (("utf-16-le", odd, even), ("utf-16-be", even, odd)):
            if len(data) >= 16 and 4 * zeros > len(data) and 8 * others < zeros:
                return data[: len(data) // 2 * 2].decode(kind, "replace").removeprefix("\ufeff")
    try:
        return data.decode("utf-8") or None
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace") if STRETCH.search(data) else None


def _sliced(data: bytes, at: int = 0) -> Iterator[bytes]:
    return (data[k : k + STEP] for k in range(at, len(data), STEP))


def _skipped(chunks: Iterator[bytes], n: int) -> Iterator[bytes]:
    for x in chunks:
        if n < len(x):
            yield x[n:]
        n = max(0, n - len(x))


class _Inflate:
    """zlib's decoder, with the ways of bz2 and lzma."""

    def __init__(self, bits: int):
        self.own = zlib.decompressobj(bits)

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.own.decompress(self.own.unconsumed_tail + data, most)

    @property
    def eof(self) -> bool:
        return self.own.eof

    @property
    def unused_data(self) -> bytes:
        return self.own.unused_data

    @property
    def needs_input(self) -> bool:
        return not self.own.unconsumed_tail


def _decoder(data: bytes) -> object:
    if data[:1] == b"\x1f":
        return _Inflate(31)
    return bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=1 << 28) if data[:1] == b"\xfd" else _Inflate(15)


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed data (of gzip all members) decode to, step by step, as far as they go."""
    decoder, gzip = None, None
    for data in chunks:
        while True:
            if decoder is None:
                if not data or (gzip is not None and data[:1] != b"\x1f"):
                    break
                gzip, decoder = data[:1] == b"\x1f", _decoder(data)
            try:
                out = decoder.decompress(data, STEP)
            except (zlib.error, lzma.LZMAError, OSError):
                return
            if out:
                yield out
            if decoder.eof:
                if not gzip:
                    return
                data, decoder = decoder.unused_data, None
            elif decoder.needs_input:
                break
            else:
                data = b""
        if decoder is None and gzip is not None and data:
            return


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, int, bool]]:
    """Windows, where each begins, and whether it is all there is."""
    held, at = bytearray(), 0
    for x in chunks:
        if len(held) + len(x) > WINDOW:
            yield bytes(held), at, False
            at += len(held) - OVERLAP
            del held[:-OVERLAP]
        held += x
    if held:
        yield bytes(held), at, at == 0


def _packed(source: Callable[[], Iterator[bytes]], seen: set[bytes]) -> Iterator[bytes | Callable[[], Iterator[bytes]]]:
    """The windows of a source that were not seen, and the sources that compressed data in them are."""
    for window, at, whole in _windows(source()):
        key = hashlib.sha256(window).digest()
        if key in seen:
            continue
        seen.add(key)
        yield window
        for m in PACKED.finditer(window):
            rest = _sliced(window, m.start())
            if next(_inflated(rest if whole else chain(rest, _skipped(source(), at + len(window)))), None) is None:  # bzip2 gives nothing before a block's end
                continue
            if whole:
                yield lambda data=window, k=m.start(): _inflated(_sliced(data, k))
            else:  # it may go on in later windows: the source is read anew up to there
                yield lambda k=at + m.start(): _inflated(_skipped(source(), k))


def _inflations(data: bytes) -> Iterator[bytes]:
    """The data, and what compressed data in them decode to, to any depth, in windows, each once."""
    seen: set[bytes] = set()
    stack = [_packed(lambda: _sliced(data), seen)]
    while stack:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
        elif callable(found):
            stack.append(_packed(found, seen))
        else:
            yield found


def _from_base64(m: re.Match) -> tuple[int, int, Iterator[str]]:
    """Where the run begins and ends, and the texts that it decodes to at each alignment; the first alone if that is plain text."""

    def texts() -> Iterator[str]:
        body = BREAKS.sub("", m[0].rstrip("=")).replace("-", "+").replace("_", "/")
        for k in range(4):
            own = body[k : len(body) - ((len(body) - k) % 4 == 1)]
            data, first = base64.b64decode(own + "=" * (-len(own) % 4)), k == 0
            for x in _inflations(data):
                if t := _text(x):
                    yield t
                    if first and t.isascii() and all(c.isprintable() or c in "\r\n\t" for c in t):
                        return
                first = False

    return m.start(), m.end(), texts()


def _size(data: bytes) -> int:
    """How many bytes the compressed data at the beginning have."""
    at = 0
    while at < len(data) and (not at or data[at : at + 2] == b"\x1f\x8b"):
        decoder, step = _decoder(data[at:]), data[at:]
        try:
            while not decoder.eof and (step or not decoder.needs_input):
                decoder.decompress(step, STEP)
                step = b""
        except (zlib.error, lzma.LZMAError, OSError):
            return len(data)
        if not decoder.eof:
            return len(data)
        at = len(data) - len(decoder.unused_data)
    return at


def _from_bytes(m: re.Match, parts: re.Pattern) -> tuple[int, int, Iterator[str]]:
    """Where compressed data begin and end in a run of bytes, and what they decode to; nothing where there are none."""
    found = [(x.start(), int(x[1], 16) if x[1] else PLAIN_ESCAPES[x[2]] if x[2] else ord(x[3])) for x in parts.finditer(m[0])]
    data = bytes(v for _, v in found)
    for x in PACKED.finditer(data):
        if next(_inflated(_sliced(data, x.start())), None) is not None:
            end = x.start() + _size(data[x.start() :])
            inside = _inflations(data[x.start() : end])
            next(inside)  # the bytes themselves are read elsewhere
            return m.start() + found[x.start()][0], m.start() + found[end][0] if end < len(found) else m.end(), (t for y in inside if (t := _text(y)))
    return m.start(), m.end(), iter(())


def _layers(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], tuple[int, int, Iterator[str]]]) -> Iterator[Layer]:
    """The layer with its runs decoded in place; texts beyond INLINE as layers of their own."""
    new = Rewritten(layer)
    for m in pattern.finditer(layer.text):
        found, size = {}, 0
        start, end, texts = decode(m)
        for t in texts:
            if size + len(t) <= INLINE:
                size += 0 if t in found else len(t)
                found[t] = None
            else:
                a, b = layer.span(start, end)
                yield Layer(t, [0], [a], [b])
        if found:
            new.replace(start, end, "\n".join(found))
    if (made := new.made()) is not None:
        yield made


def _escaped(m: re.Match) -> str | None:
    code = int(m[7]) if m[7] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """What a layer's encoded parts decode to, one layer for each way."""
    text = layer.text
    if "%" in text:
        if x := _replaced(layer, URL, lambda m: _text(bytes.fromhex(m[0].replace("%", "")))):
            yield x
        yield from _layers(layer, URL_RUN, lambda m: _from_bytes(m, URL_BYTE))
    if ("\\" in text or "&#" in text or "%u" in text) and (x := _replaced(layer, ESCAPE, _escaped)):
        yield x
    if "\\" in text and (x := _replaced(layer, QUOTED, lambda m: m[1])):
        yield x
    if "\\x" in text:
        yield from _layers(layer, LITERAL_RUN, lambda m: _from_bytes(m, LITERAL_BYTE) if "\\x" in m[0] else (m.start(), m.end(), iter(())))
    if BASE64.search(text):
        for pattern in (BASE64, WRAPPED):
            yield from _layers(layer, pattern, _from_base64)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the text itself, and all spans; both by start, then kind, then end."""
    order = lambda x: sorted(set(x), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    base = matches(text)
    found, seen = set(base), set()
    stack = [unwrapped(Layer(text))]
    while stack:
        layer = next(stack[-1], None)
        if layer is None:
            stack.pop()
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in matches(layer.text):
            if not layer.copied(start, end):  # plain text was found before
                found.add((kind, *layer.span(start, end)))
        stack.append(unwrapped(layer))
    return order(base), order(found)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the text's own spans), spans (all, joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = scan(text)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All columns of docs; each span (overlapping ones joined) of text replaced by mask. Null text stays null."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, a, b in scan(text)[1]:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mask]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    kept = bounded(docs).mapInArrow(run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept

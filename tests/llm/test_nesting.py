"""Secrets under every pair of encodings, generated; clean text is left alone."""

import base64
import bz2
import gzip
import itertools
import lzma
import random
import urllib.parse
import zlib

import pytest

from tidemark.llm import secret_scan

SECRET = 'password = "hunter22hunter22!"'


def deflated(data, level, bits):
    own = zlib.compressobj(level, zlib.DEFLATED, bits)
    return own.compress(data) + own.flush()


PACKERS = {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, **{f"zlib{b}-{n}": lambda d, b=b, n=n: deflated(d, n, b) for b in (9, 12, 15) for n in (1, 6, 9)}}
WRITERS = {
    "base64": lambda d: base64.b64encode(d).decode(),
    "base64url": lambda d: base64.urlsafe_b64encode(d).decode().rstrip("="),
    "mime": lambda d: base64.encodebytes(d).decode(),
    "url": urllib.parse.quote,
    "url_all": lambda d: "".join(f"%{b:02x}" for b in d),
    "literal": lambda d: repr(d)[2:-1],
    "literal_all": lambda d: "".join(f"\\x{b:02x}" for b in d),
}
OF_TEXT = {
    "json": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "percent_u": lambda t: "".join(f"%u{ord(c):04X}" for c in t),
    "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "html_hex": lambda t: "".join(f"&#x{ord(c):x};" for c in t),
    "utf16": lambda t: base64.b64encode(t.encode("utf-16")).decode(),
    "utf16be": lambda t: base64.b64encode(t.encode("utf-16-be")).decode(),
}
#: Text to text: packed and written, written alone, or escaped.
WAYS = {**{f"{p}+{w}": lambda t, p=p, w=w: WRITERS[w](PACKERS[p](t.encode())) for p in ("gzip", "zlib15-6", "bz2", "xz") for w in WRITERS}, **{w: lambda t, w=w: WRITERS[w](t.encode()) for w in WRITERS}, **OF_TEXT}


def found(text):
    return [s for s in secret_scan.scan(text)[1] if s[0] == "assign"]


@pytest.mark.parametrize("packer", PACKERS)
@pytest.mark.parametrize("writer", WRITERS)
def test_every_packer_under_every_writer(packer, writer):
    """Also between other data: the secret's span is inside what was written."""
    for level, inside in enumerate((SECRET, f"{'filler text ' * 40}{SECRET} and more")):
        written = WRITERS[writer](PACKERS[packer](inside.encode()))
        text = f"before {written}\nafter" if level else written
        spans = found(text)
        assert any(text.index(written) <= a and b <= text.index(written) + len(written) for _, a, b in spans), text[:200]


@pytest.mark.parametrize("outer", WAYS)
def test_every_pair_of_ways(outer):
    for inner in WAYS:
        text = f"x {WAYS[outer](WAYS[inner](SECRET))} y"
        assert found(text), (outer, inner)


def test_triples():
    rng = random.Random(3)
    for names in rng.sample(list(itertools.product(WAYS, repeat=3)), 60):
        text = SECRET
        for n in names:
            text = WAYS[n](text)
        assert found(f"x {text} y"), names


def test_clean_text_is_left_alone():
    rng = random.Random(4)
    for k in range(40):
        clean = " ".join(rng.choice(["word", "100%", "a%20b", "\\n", "C:\\x86\\bin", "x=y", "BZh91", "%uABCD", "&#65;", "8%9Cq", "é", "(%41)"]) for _ in range(200))
        data = bytes(rng.randrange(256) for _ in range(2000))
        for text in (clean, WRITERS["base64"](data), urllib.parse.quote(data), repr(data)[2:-1], WRITERS["base64"](gzip.compress(clean.encode()))):
            assert not found(text), (k, text[:100])


def test_cut_and_damaged_data():
    for packer in PACKERS:
        data = PACKERS[packer]((f"{SECRET} " + " ".join(str(i * 7919) for i in range(4000))).encode())
        for part in (data[: len(data) // 2], data[:-3], data[:40] + b"\xff\xff" + data[42:]):
            secret_scan.scan(WRITERS["base64"](part))
        if not packer.startswith(("bz2", "xz")):
            assert found(WRITERS["base64"](data[: len(data) * 3 // 4])), packer


@pytest.mark.parametrize("window", [secret_scan.WINDOW, 1 << 17])
def test_a_bzip2_block_gives_nothing_before_its_end(monkeypatch, window):
    """Its compressed bytes are more than a step, and more than a window."""
    monkeypatch.setattr(secret_scan, "WINDOW", window)
    letters = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz ", k=200_000)).encode()
    data = b"noise" * 9000 + bz2.compress(letters + b" password = hunter2hunter2 " + letters)
    assert len(data) > 2 * secret_scan.STEP
    assert any(b" password = hunter2hunter2 " in x for x in secret_scan._inflations(data))

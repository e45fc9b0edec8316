import base64
import gzip
import hashlib
import random
import time
import tracemalloc
import urllib.parse
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, ngramjoin, packing, quality, secret_scan, spotsigs, substring, toxicity, warc

from . import brute

DOCS = "/root/testdata/sf0.001/documents.parquet"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "One two THREE"), (7, "a b c d e"), (8, "a b c d e"),
    (9, " ".join(f"w{i}" for i in range(30))), (10, "x " + " ".join(f"w{i}" for i in range(30)) + " y"), (11, "é " * 25), (12, "é " * 25), (13, " ".join(f"v{i % 7}" for i in range(5000))), (14, "z" * 20000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The small table and edge cases, with columns whose names the operators use themselves."""
    own = spark.read.parquet(DOCS).select("doc_id", "text")
    rng, base = random.Random(5), [f"q{i}" for i in range(300)]
    near = []
    for k in range(60):  # a group of near copies, all different
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
        near.append((2_000_000 + k, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(60))
    near += [(3_000_000 + k, " ".join(f"s{rng.randrange(10**6)}" for _ in range(40)) + " " + shared) for k in range(60)]
    edge = spark.createDataFrame([(d + 1_000_000, t) for d, t in EDGE] + near, "doc_id long, text string")
    all_ = own.unionByName(edge)
    return all_.selectExpr("doc_id", "text", "'a' AS a", "1 AS block", "2 AS component", "3 AS n", "null AS lang").cache()


@pytest.fixture(scope="module")
def table(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_is_exact(docs, table):
    ours = by_id(bpe.digests(docs, RANKS))
    ids = by_id(bpe.encode(docs, RANKS))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for d, text in table.items():
        want = theirs.encode_ordinary(text or "")
        assert ids[d].ids == want == tok.encode(text or "", add_special_tokens=False).ids
        assert ours[d].n_tokens == len(want)
        assert ours[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert all(bytes(r.bytes) == (table[r.doc_id] or "").encode() for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect())


def test_bpe_on_odd_text():
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    letters = "'strevmldx ab  \n\t\r ²½é中文🙂0١9$$%%'' STdon"
    batch = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 500, "", "<|endoftext|>"]
    assert [x.tolist() for x in bpe.encoder(RANKS).encode(batch)] == [theirs.encode_ordinary(x) for x in batch]


def test_packing_covers_every_id_once(docs, table):
    rows = packing.pack(docs, RANKS, more=True).collect()
    ids = by_id(bpe.encode(docs, RANKS))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(table)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == ids[d].ids + [1]
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.doc_tokens == len(ids[d].ids) + 1 for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_fill_does_not_depend_on_tasks(spark):
    """Within a hundredth of the best there can be, by the number of ids, at any number of tasks; nothing lost or met twice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts in (1, 40):
        rows = packing.pack(docs.repartition(parts, "doc_id"), RANKS).collect()
        total, used = sum(r.length for r in rows), len({r.sequence_id for r in rows})
        assert len({(r.doc_id, r.start) for r in rows}) == len(rows) and total == sum({r.doc_id: r.doc_tokens for r in rows}.values())
        assert total >= 0.99 * 2048 * used, (parts, total, used)


def test_packing_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "x " * 5000)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS length", "3 AS sequence_id")
    rows = packing.pack(df, RANKS).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1), (0, 2), (1, 3), (1, 3), (2, rows[-1].doc_tokens if rows[-1].doc_id == 2 else next(r.doc_tokens for r in rows if r.doc_id == 2))]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "中文字符"])
def test_bpe_takes_linear_time(letters):
    own, rng, took = bpe.encoder(RANKS), random.Random(1), []
    for n in (10**4, 10**5, 10**6):
        text = "".join(rng.choices(letters, k=n))
        began = time.process_time()
        ids = next(own.encode([text]))
        took.append(time.process_time() - began)
        assert b"".join(own.merges.bytes[i] for i in ids) == text.encode()
    assert took[2] < 40 * took[1] + 1 and took[2] < 20


def test_bpe_in_parts_and_one_by_one(monkeypatch):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(8)
    batch = ["".join(rng.choices("'strevmldx ab  \n\t\r ²½é中文🙂0١9$$%%'' STdon", k=rng.randint(0, 900))) for _ in range(300)]
    want = [theirs.encode_ordinary(x) for x in batch]
    for kind, name, value in ((bpe.Merges, "LONG", 3), (bpe.Encoder, "STEP", 50), (bpe.Encoder, "LIMIT", 10)):
        monkeypatch.setattr(kind, name, value)
        assert [x.tolist() for x in bpe.Encoder(RANKS).encode(batch)] == want


def test_bpe_pieces_with_one_hash(monkeypatch):
    import numpy as np

    own = bpe.Encoder(RANKS)
    want = [x.tolist() for x in own.encode(["one two one three", "two four"])]
    monkeypatch.setattr(bpe, "span_hashes", lambda values, start, end: np.full(len(start), 7, np.uint64))
    assert [x.tolist() for x in bpe.Encoder(RANKS).encode(["one two one three", "two four"])] == want


def test_fill_finds_the_nearest_sum():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        have = {x: items.count(x) for x in items}
        best = max(s for s in {sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(1 << len(items))} if s <= 60)
        taken = packing.fill(have, 60)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= have[n] for n, k in taken.items())


def test_rules(docs, table):
    got = by_id(quality.score(docs, None))
    for d, text in table.items():
        r = got[d]
        want = brute.rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"), bound=1500)
    held = quality.score(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), model).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in held) >= 0.97 * len(held)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None and toxicity.train(docs, none) is None
    assert quality.keep(docs, none).columns == docs.columns
    assert all(r.score == 0 for r in toxicity.score(docs, None).collect())


def test_substring(docs, table):
    got, want = by_id(substring.digests(docs)), brute.removed(table)
    for d, kept in want.items():
        n = len(brute.words(table[d]))
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), d
    left = by_id(substring.strip(docs))
    assert all(brute.words(left[d].text) == k if d in left else not k for d, k in want.items())


@pytest.mark.parametrize("least", [4, 10**9])
def test_substring_hot_passage_is_spread(spark, docs, table, least, monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring.repeated_spans, "__defaults__", (substring.WINDOW, substring.GRAM, least))
    got = by_id(substring.digests(docs))
    for d, kept in brute.removed(table).items():
        assert (got[d].n_removed, got[d].kept_sha256) == (len(brute.words(table[d])) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), d
    passage = [f"p{i}" for i in range(30)]
    rows = [(k, " ".join([f"a{k}.{i}" for i in range(30)] + passage + [f"b{k}.{i}" for i in range(30)])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = substring.hot_representatives(df, substring.WINDOW, substring.GRAM, 100)
    assert 1 <= len(hot) <= 20 and substring.hot_representatives(df.limit(0), substring.WINDOW, substring.GRAM).tolist() == []
    h, n = substring._summed(np.array([7] * 50 + list(range(100, 160)), np.uint64), np.ones(110, np.int64), 10)
    assert len(h) <= 10 and 50 - 11 <= n[h == 7][0] <= 50


def test_substring_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, f"{c} {b}"), (9, c), (None, a), (None, c), (9, None), (2, "")]
    df = spark.createDataFrame([(i, t, 3, "r", 1, 2) for i, t in rows], "doc_id long, text string, n_chars int, removed string, doc int, twin int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.digests(df).collect())
    assert got == sorted([("1", 40, 0), ("5", 40, 40), ("5", 40, 0), ("5", 40, 0), ("7", 80, 40), ("9", 40, 40), ("None", 40, 0), ("None", 40, 0), ("9", 0, 0), ("2", 0, 0)])
    left = substring.strip(df)
    assert left.columns == df.columns and sorted((str(r.doc_id), r.text, r.n_chars, r.removed) for r in left.collect()) == sorted([("1", a, len(a), "r"), ("5", b, len(b), "r"), ("5", b, len(b), "r"), ("7", c, len(c), "r"), ("None", a, len(a), "r"), ("None", c, len(c), "r"), ("9", None, None, "r"), ("2", "", 0, "r")], key=str)


def test_substring_third_of_all_rows_without_id(spark):
    """They meet under no key: no task has many of them."""
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{i}.{k}" for k in range(25))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, _ = substring._with_removed(df, 20)
        found = joined.where("doc_id is null").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in found) == 500 and max(r["count"] for r in found) < 100


def test_fm_index_counts():
    rng = random.Random(2)
    parts = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(4, 40))] for _ in range(60)]
    flags, offset = substring.seen_before(parts, 4)
    seen, want = set(), []
    for p in parts:
        for i in range(len(p) - 3):
            want.append(tuple(p[i : i + 4]) in seen)
            seen.add(tuple(p[i : i + 4]))
    assert flags.tolist() == want


def test_ngram_join(docs, table):
    got, want = by_id(ngramjoin.join(docs)), brute.groups(table)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    first = {d for d, (n, c) in want.items() if d == c}
    assert {r.doc_id for r in ngramjoin.keep_first(docs).collect()} == first


def test_ngram_join_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (9, f"{b} more"), (None, a), (None, c), (2, None), (2, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, first int").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngramjoin.join(df).collect())
    assert got == sorted([("1", 36, 1), ("5", 36, 1), ("5", 36, 5), ("5", 36, 5), ("9", 37, 5), ("None", 36, None), ("None", 36, None), ("2", 0, 2), ("2", 0, 2)], key=lambda r: (r[0], r[1], r[2] or 0))
    left = ngramjoin.keep_first(df)
    assert left.columns == df.columns
    assert sorted(((str(r.doc_id), r.text) for r in left.collect()), key=str) == sorted([("1", a), ("5", b), ("None", a), ("None", c), ("2", None), ("2", "")], key=str)


def test_ngram_join_random(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"{g}.{i}" if i % 3 else f"c{i % 11}" for i in range(rng.randint(6, 80))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w[: rng.randint(len(w) - 4, len(w))])))
    got = by_id(ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.groups(dict(rows))


@pytest.mark.parametrize("split", [8192, 40])
def test_ngram_join_of_a_template(spark, monkeypatch, split):
    """Documents with most words in common: some can't be linked, some are, and their common n-grams are cut into parts."""
    monkeypatch.setattr(ngramjoin, "SPLIT", split)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(160)]
    own = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts = [template + own(40) for _ in range(300)] + [own(rng.randint(0, 50)) + template[: rng.randint(100, 160)] + own(rng.randint(0, 30)) for _ in range(150)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = by_id(ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.groups(dict(rows))


def test_ngram_join_compares_few_of_a_template(spark, monkeypatch):
    """No two of these can be linked, and the sizes say so before pairs are made."""
    compared, crossing, verified = [], ngramjoin._crossing, ngramjoin._verified

    def counted(*args):
        compared.append(crossing(*args).count())
        return crossing(*args)

    monkeypatch.setattr(ngramjoin, "_crossing", counted)
    monkeypatch.setattr(ngramjoin, "_verified", lambda pairs, *args: compared.append(pairs.count()) or verified(pairs, *args))
    rows = [(d, " ".join([f"t{i}" for i in range(160)] + [f"u{d}.{i}" for i in range(40)])) for d in range(1500)]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).where("component_id <> doc_id").count()
    assert got == 0 and sum(compared) < 1500


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in ngramjoin.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == root


def test_secrets_base(docs, table):
    got = by_id(secret_scan.find(docs))
    for d, text in table.items():
        spans = brute.secrets(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[d].n_hex == sum(k == "hex" for k, _, _ in spans)
        assert set(joined.split(",")) <= set(got[d].spans.split(","))


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(), urllib.parse.quote, lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), lambda s: urllib.parse.quote(base64.b64encode(s.encode()).decode()), lambda s: base64.b64encode("".join(f"%{b:02x}" for b in s.encode()).encode()).decode(),
])
def test_secrets_in_layers(wrap):
    inner = wrap('password = "hunter22hunter22!"')
    text = f"é before {inner} after"
    base, spans = secret_scan.scan(text)
    at = text.index(inner)
    new = [s for s in spans if s not in base]
    assert any(k == "assign" and at - 1 <= a < b <= at + len(inner) for k, a, b in new or spans)


def _b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def _often(data, times):
    for _ in range(times):
        data = gzip.compress(data)
    return data


def _lines(s, end="\n", width=76):
    return end.join(s[i : i + width] for i in range(0, len(s), width))


_SECRET = 'password = "hunter22hunter22!"'
_NOISE = " ".join(hashlib.md5(b"%d" % i).hexdigest()[:9] for i in range(60))


@pytest.mark.parametrize("inner", [
    *[_b64(f"some words {c} and {_SECRET} and more") for c in "\u00a0\ufeff\u200d\f\0"], _b64("some words é ".encode("latin-1") + _SECRET.encode()),
    *[prefix + _b64(_SECRET) for prefix in ("host/x/", "auth-", "a_", "abc/", "ab", "x")], *[prefix + _b64(gzip.compress(_SECRET.encode())) for prefix in ("host/x/", "auth-", "ab")], _b64(_SECRET + "12") + "/path/of",
    *[_lines(_b64(gzip.compress((_NOISE + _SECRET + _NOISE).encode())), end) for end in ("\n", "\r\n", "\n    ", "\\n")], _lines(_b64("x" * 45 + _SECRET)), "auth-" + _lines(_b64("x" * 45 + _SECRET)),
    _b64(_often(_SECRET.encode(), 12)), _b64(gzip.compress(_SECRET[:15].encode()) + gzip.compress(_SECRET[15:].encode())), "".join(f"%{b:02x}" for b in b"\xe9 " + _SECRET.encode()),
])
def test_secrets_behind_ordinary_obstacles(inner):
    text = f"é before {inner} after"
    base, spans = secret_scan.scan(text)
    at = text.index(inner)
    assert not any(k == "assign" for k, _, _ in base)
    assert any(k == "assign" and at <= a < b <= at + len(inner) for k, a, b in spans)


def test_secrets_ends_and_leaves_clean_text():
    secret_scan.scan("\\u005cu005cu0025 %2525252541 " + base64.b64encode(gzip.compress(b"a" * 10_000_000)).decode()[:200])
    clean = "The quick brown fox: a token of thanks, api docs, key = none. " * 50
    assert secret_scan.scan(clean) == ([], [])


@pytest.mark.parametrize("times", [9, 40])
def test_secrets_under_many_layers(times):
    inner = _b64(_often(_SECRET.encode(), times))
    assert secret_scan.scan(f"a {inner} b")[1] == [("assign", 2, 2 + len(inner))]
    text = _SECRET
    for _ in range(8):
        text = _b64(zlib.compress(text.encode()))
    assert secret_scan.scan(text)[1] == [("assign", 0, len(text))]


@pytest.mark.parametrize("make", [gzip.compress, lambda x: gzip.compress(gzip.compress(x)), lambda x: gzip.compress(b"\0" * 3 + gzip.compress(x[: len(x) // 2]) + gzip.compress(x[len(x) // 2 :]))])
def test_secrets_in_a_bomb_take_bounded_memory(make):
    """64 MB of zeros, a secret, 64 MB of zeros, in some 100 KB or less."""
    inner = _b64(make(bytes(64 << 20) + b" " + _SECRET.encode() + b" " + bytes(64 << 20)))
    tracemalloc.start()
    _, spans = secret_scan.scan(f"a {inner} b")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [("assign", 2, 2 + len(inner))] and most < 64 << 20


def test_secrets_same_text_at_other_places():
    one = _b64(_SECRET)
    text = f"{one} and {one}"
    assert [(a, b) for k, a, b in secret_scan.scan(text)[1] if k == "assign"] == [(0, len(one)), (len(one) + 5, len(text))]
    assert secret_scan.scan("%70assword=abcdefgh1 ")[1] == [("assign", 0, 20)]


def test_redact(docs, table):
    left = by_id(secret_scan.redact(docs))
    assert all((left[d].text is None) == (t is None) for d, t in table.items())
    assert all(not secret_scan.scan(r.text or "")[0] for r in left.values())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, index).join(labels.where(toxicity.held_out()), "doc_id").collect()
    bad, good = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(bad) >= 0.92 * len(bad) and sum(good) <= 0.01 * len(good)
    # one telling word in a long clean text is outweighed
    word = max((t for t in index.vocabulary if not t.startswith(b"^")), key=lambda t: index.idf[index.vocabulary[t]]).decode()
    clean = " ".join(r.text for r in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect())
    assert index.score(f"{clean} {word}")[0] < 0.5


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"fine words here {i % 7} and more", 0) for i in range(60)] + [(100 + i, f"vile nasty vile {i % 5} words", 1) for i in range(30)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    index = toxicity.train(docs.union(docs), labels)
    assert len(index.ids) == 90  # one of each id
    odd = spark.createDataFrame([(None, "vile nasty"), (1, None), (1, ""), (1, "vile nasty vile"), (1, "vile nasty vile"), (2, "fine words here"), (3, "unseen")], "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score", "3 AS evidence")
    got = [(r.doc_id, r.predicted, r.evidence) for r in toxicity.score(odd, index).collect()]
    assert [p for _, p, _ in got] == [1, 0, 0, 1, 1, 0, 0] and got[3] == got[4]
    assert got[3][2] == sorted(got[3][2]) and not got[1][2]  # equally near: by id
    assert [r[0] for r in odd.select(toxicity.held_out()).collect()][0] is False


def test_nearest_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.sqrt(w @ w) if len(t) else w))
    rows[200:240] = rows[:40]  # ties
    index = toxicity.Index({bytes([i]): i for i in range(40)}, np.ones(40), rows, rng.integers(0, 2, 500), np.arange(500))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for t, w in rows[:100]:
        near, cosine = index.nearest(t, w)
        q = np.zeros(40)
        q[t] = w
        want = np.sort(dense @ q)[::-1][:15]
        order = np.lexsort((np.arange(500), -np.round(dense @ q, 12)))[: len(near)]
        assert sorted(near[np.round(cosine, 9) > np.round(cosine[-1:], 9)]) == sorted(order[np.round(cosine, 9) > np.round(cosine[-1:], 9)])
        assert np.allclose(cosine, want[want > 1e-12][: len(cosine)]) and len(cosine) == min(15, int((want > 1e-12).sum()))


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "s>", "[", "INST]", "\n", "ok", " ", "é🙂", "</", "]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a]b", "x\\", "</s>", None]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(8))])) for c in range(150) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS own", "2 AS formatted", "3 AS level")
    formatted = chat.format_conversations(df)
    spans = {r.conv_id: r.spans for r in chat.loss_spans(formatted).collect()}
    for r in formatted.collect():
        own = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: x[1])
        assert r.identical and [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        shown = [r.formatted[s.start : s.end] for s in spans[r.conv_id]]
        assert shown == [t.shown for t in r.turns if t.role == "assistant"]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_warc_round_trip(spark, chunk):
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "WARC/1.1\r\n\r\nz" * 30, "big" * 100_000 if chunk > 100 else "big" * 100]
    rows = [(i, None if i == 2 else f"http://e.com/é {i}\r\nX: y", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n", "2 AS digest", "3 AS path")
    manifest, folder = warc.archive(pages, chunk=chunk)
    got = {r.page_id: r for r in warc.records(manifest, folder).collect()}
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        seen = first.setdefault(data, i) if len(data) >= 100 else i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if seen == i else "revisit", None if seen == i else seen)
    text = b"".join(bytes(r.data) for r in warc.read_chunks(manifest, folder, chunk).where("page_id = 9").orderBy("chunk_no").collect())
    assert text == html[9].encode()
    assert warc.records(*warc.archive(pages.limit(0))).count() == 0


def test_warc_null_and_repeated_ids(spark):
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(None, a), (None, a), (None, b), (None, "s"), (None, None), (5, b), (5, b), (5, c), (7, c), (7, c), (7, "s"), (8, c)]
    pages = spark.createDataFrame([(i, f"u{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string")
    manifest, folder = warc.archive(pages, chunk=40)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(manifest, folder).collect()), key=str)
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    refers = [None, None, 5, None, None, None, None, None, 5, 5, None, 5]
    assert got == sorted(((i, sha(h), "response" if r is None else "revisit", r) for (i, h), r in zip(rows, refers, strict=True)), key=str)
    heads = b"".join(gzip.decompress(open("/" + r.path.lstrip("/"), "rb").read()) for r in manifest.collect()).decode()
    ids = [x.split(": ")[1] for x in heads.split("\r\n") if x.startswith("WARC-Record-ID")]
    assert len(set(ids)) == len(rows)
    assert {x.split(": ")[1] for x in heads.split("\r\n") if x.startswith("WARC-Refers-To")} <= set(ids)


@pytest.mark.parametrize("chunk", [1, 7, 1000, 1 << 16])
def test_warc_members_at_any_block_size(chunk):
    import io

    rng = random.Random(chunk)
    bodies = [bytes(rng.choices(b"abc <>", k=rng.randint(0, 3000))) for _ in range(40)]
    data = b"".join(gzip.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + warc.END, 1) for b in bodies)
    found: list[bytes] = []
    for fields, part in warc._members(io.BytesIO(data), chunk):
        if fields is not None:
            found.append(b"")
        else:
            found[-1] += part
    assert found == bodies


def test_spotsigs(docs, table):
    got, order = by_id(spotsigs.fingerprints(docs)), sorted(table)
    for i, d in enumerate(order):
        text, after = table[d] or "", table[order[(i + 1) % len(order)]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    prints = {}
    for d in order:
        assert prints.setdefault(table[d], got[d].fingerprint) == got[d].fingerprint
    members, pairs = spotsigs.near_pairs(docs)
    sets = {r.doc_id: set(r.s) for r in spotsigs.with_signatures(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), "text", "s").collect()}
    reps = sorted({r.rep for r in members.collect()})
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def _signatures(text):
    """A plain version: the chains themselves in place of their hashes."""
    common = {w for words in spotsigs.COMMON.values() for w in words}
    words = [w for w in text.lower().translate({ord(c): " " for c in spotsigs._BREAKS}).split(" ") if w]
    content = [(w, i > 0 and words[i - 1] in common) for i, w in enumerate(words) if w not in common]
    if len(content) < spotsigs.CHAIN:
        return {("short", *words)} if words else set()
    chains = [(tuple(w for w, _ in content[i : i + spotsigs.CHAIN]), content[i][1]) for i in range(len(content) - spotsigs.CHAIN + 1)]
    return {c for c, anchored in chains if anchored} or {c for c, _ in chains}


def test_spotsigs_against_plain_sets(docs, table):
    got, order = by_id(spotsigs.fingerprints(docs)), sorted(table)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, d in enumerate(order):
        text, after = table[d] or "", table[order[(i + 1) % len(order)]] or ""
        own, edited = _signatures(text), _signatures(text[: len(text) - len(text) // 4] + after[: len(text) // 4])
        assert (int(got[d].fingerprint.split(":")[0]), int(got[d].edited_fingerprint.split(":")[0])) == (len(own), len(edited))
        assert got[d].near_edited == pytest.approx(like(own, edited)) and got[d].near_next == pytest.approx(like(own, _signatures(after)))


def test_spotsigs_short_and_long_texts(spark):
    long = " ".join(f"the w{i}" for i in range(400))
    texts = ["apple", "pear", "the apple", "apple", "  ", "", long, long.replace("w200", "other")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(spotsigs.fingerprints(df))
    assert len({got[i].fingerprint for i in (0, 1, 2, 4)}) == 4 and got[0].fingerprint == got[3].fingerprint and got[4].fingerprint == got[5].fingerprint
    assert got[0].near_next == 0.0 and got[4].near_next == 1.0
    a, b = (set(got[i].fingerprint.split(":")[1].split(".")) for i in (6, 7))
    assert len(a) == 398 and got[6].near_next == len(a & b) / len(a | b) < 1
    rep = {r.doc_id: r.rep for r in spotsigs.near_pairs(df)[0].collect()}
    assert [rep[i] for i in range(6)] == [0, 1, 2, 0, 4, 4]


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for df in (bpe.digests(none, RANKS), packing.pack(none, RANKS), quality.score(none, None), substring.digests(none), substring.strip(none), ngramjoin.join(none), secret_scan.find(none), toxicity.score(none, None), spotsigs.fingerprints(none)):
        assert df.count() == 0


def test_warc_payload_of_a_third_of_all_pages(spark):
    """No task of the join has the payload's pages together, with ids or without."""
    from pyspark.sql import functions as F

    rows = spark.range(12_000).selectExpr("if(id % 9 = 0, null, id) AS page_id", "'u' AS url", "if(id % 3 = 0, repeat('same ', 40), concat('own ', id, repeat(' x', 60))) AS html").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = warc.revisits(rows)
        assert found.agg(F.count("*"), F.max("refers_to")).first() == (2666, 3)  # one of them for all rows without an id
        joined = found.sparkSession.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
        held = warc.with_totals(joined, ["payload_digest"], F.col("row"), n=("sum", F.lit(1)))
        assert held.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")

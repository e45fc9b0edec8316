"""Fill-in-middle, chunk recipes and spelling variants against plain versions, and their edge cases."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunks, fim, spelling
from tidemark.llm.common import with_totals

DOCS = "/root/testdata/sf0.001/documents.parquet"
LONG = "word and other words, " * 60_000
EDGE = [
    (1, None), (2, ""), (3, " \n\t\r\x0b\x0c"), (4, "a"), (5, "é"), (6, "中文 text 🙂 and more"), (7, "has <M> inside"), (8, "almost <P <S M>"), (9, "ab  c"), (10, "a b\nc"), (11, "abc"), (12, "abc"), (12, "abc"),
    (None, "abc"), (None, "abc"), (None, "of its own"), (13, LONG), (14, LONG.replace(" ", "")), (15, LONG + "!"), (16, " abc"), (17, "🙂" * 9000), (18, "🙂" * 9000 + " "), (19, "z" * 20_000), (20, "z" * 20_001),
]


@pytest.fixture(scope="module")
def docs(spark):
    edge = spark.createDataFrame([(d if d is None else d + 1_000_000, t) for d, t in EDGE], "doc_id long, text string")
    both = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(edge)
    return both.selectExpr("doc_id", "text", "'a' AS row", "1 AS recipe", "2 AS best", "3 AS n", "'x' AS form_", "null AS lang", "4 AS cut").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim_of(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain:
        return len(t), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_against_strings(docs):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, form, p, m, out = fim_of(r.doc_id, r.text)
        want[(r.doc_id, n, form, p, m, sha(out), sha(r.text or ""))] += 1
    assert Counter(map(tuple, fim.digests(docs).collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_piece_tables_and_texts(docs):
    """Pieces stand for the output; texts come back from it; other columns stay; another choice gives other cuts."""
    how = fim.Choice(seed=9, plain=0, spm=50)
    made = fim.transformed(docs, how)
    assert made.columns == [*docs.columns, "form"]
    assert Counter((r.doc_id, r.text, r.form) for r in made.collect()) == Counter((r.doc_id, fim_of(r.doc_id, r.text, 9, 0, 50)[4], fim_of(r.doc_id, r.text, 9, 0, 50)[1]) for r in docs.collect())
    back = fim.whole(made)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.withColumn("text", F.coalesce("text", F.lit(""))).collect()))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id != None}  # noqa: E711
    for r in fim.arrange(docs).where("doc_id IS NOT NULL").collect():
        out = b"".join((texts[r.doc_id], fim.SENTINELS)[p.buffer][p.start : p.end] for p in r.pieces)
        assert hashlib.sha256(out).hexdigest() == r.output_sha256
    with pytest.raises(ValueError):
        fim.transformed(docs, form="row")


def test_fim_tables():
    assert fim.split(fim.split([(0, 0, 10)], 4), 4) == [(0, 0, 4), (0, 4, 10)]
    assert fim.arranged(10, 4, 4, "psm") == [(1, 0, 3), (0, 0, 4), (1, 3, 6), (0, 4, 10), (1, 6, 9)]
    assert fim.arranged(10, 2, 5, "spm") == [(1, 3, 6), (0, 5, 10), (1, 0, 3), (0, 0, 2), (1, 6, 9), (0, 2, 5)]
    with pytest.raises(ValueError):
        fim.restored(b"x<P>a<S>b<M>c", "psm")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def chunk_groups(rows):
    """doc_id, keep_id, size, kept, digest of every row."""
    by = {}
    for d, t in rows:
        by.setdefault(normal(t), []).append((-len(t or ""), d is None, d if d is not None else 0, d))
    out = Counter()
    for text, own in by.items():
        own.sort(key=lambda x: x[:3])
        for i, x in enumerate(own):
            out[(x[3], own[0][3], len(own), i == 0, sha(text))] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_chunks_against_plain(docs, weak):
    """Also where the first identifiers stand for many chunks: another seed is taken."""
    seeds = []

    def identify(chunk, seed):
        seeds.append(seed)
        return F.length(chunk).cast("string").cast("binary") if weak and seed < 2 else chunks.md5_of(chunk, seed)

    got = chunks.groups(docs, identify)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == chunk_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert max(seeds) == (2 if weak else 0)


def test_chunks_store_restores_texts(docs):
    made = chunks.recipes(docs, 0).withColumn("row", F.monotonically_increasing_id()).cache()
    back = chunks.restored(made, chunks.store(docs), "row").join(made, "row")
    assert back.where(F.sha2(F.col("text"), 256) != F.col("text_sha256")).count() == 0 and back.count() == docs.count()


def test_chunks_are_cut_by_content(spark):
    """Text before a passage changes few of its chunks; chunks have their bounds."""
    rng = random.Random(4)
    passage = "".join(rng.choices(string.ascii_lowercase, k=60_000))
    rows = spark.createDataFrame([(k, "".join(rng.choices(string.ascii_lowercase, k=k * 37)) + passage) for k in range(6)], "doc_id long, text string")
    sets = {r.doc_id: r.c for r in rows.select("doc_id", chunks.cut(F.col("text")).alias("c")).collect()}
    assert all("".join(c) == r.text for r in rows.collect() for c in [sets[r.doc_id]])
    assert all(len(set(sets[0]) & set(sets[k])) > 0.8 * len(sets[0]) for k in sets)
    assert all(chunks.LEAST <= len(x) <= chunks.MOST for c in sets.values() for x in c[:-1])


def test_chunks_keep(docs, empty):
    kept = chunks.keep(docs)
    assert kept.columns == docs.columns
    want = Counter(d for (d, _, _, k, _), n in chunk_groups([(r.doc_id, r.text) for r in docs.collect()]).items() if k for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert chunks.keep(empty).count() == 0 and chunks.groups(empty).count() == 0 and fim.digests(empty).count() == 0 and spelling.variants(empty).count() == 0


def test_totals_without_a_hot_task(spark):
    """A third of the rows in one group: no join or sum of rows has it in one task."""
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, -1, id) AS key").repartition(6).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = with_totals(rows, ["key"], F.col("id"), n=("sum", F.lit(1)), first=("min", F.col("id")))
        most = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
        assert got.where("key = -1").select("n", "first").distinct().collect() == [(10_000, 0)]
        assert got.where("key <> -1 AND (n <> 1 OR first <> id)").count() == 0 and got.count() == 30_000
        assert most < 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def near(a, b):
    """One edit, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_of(rows, one_in=199):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def variants_of(words):
    form = {}
    out = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def test_spelling_against_plain(spark, docs):
    """Words of the tables with many letters dropped, and a corpus of invented variants that lead on over several steps."""
    rng = random.Random(6)
    alphabet = "abcdé"
    base = ["".join(rng.choices(alphabet, k=rng.randint(6, 9))) for _ in range(40)]
    rows = [(k, " ".join(rng.choices(base, k=400))) for k in range(30)]
    for w in base[:20]:
        for times in (5, 30, 180):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + "x" + w[i + 1 :], w[:i] + "y" + w[i:], w[:i] + w[i + 1 :] + "z"])
            rows.append((len(rows), f"{w.title()} " * times))
    rows += [(900, f"chains{'abc'[: k + 1]} " * 5 * 6**k) for k in range(4)] + [(None, "nullid " * 7), (None, None), (901, "q" * 3000 + " "), (901, "q" * 3001)] + [(902, ("q" * 3000 + " ") * 30 + ("q" * 3001 + " ") * 5)]
    made = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS root")
    for one_in, table in ((199, made), (7, made), (199, docs.union(docs).union(docs))):
        words = words_of([(r.doc_id, r.text) for r in table.collect()], one_in)
        got = spelling.forms(spelling.vocabulary(table, one_in=one_in))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == variants_of(words) and got.count() == len(words)


@pytest.mark.parametrize("size", [1, 3, 50, 4096])
def test_spelling_pairs_in_slices(spark, size):
    """Short words too, blocks far larger than a slice, each pair once a direction."""
    rng = random.Random(2)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))): 1 for _ in range(300)} | {"comput" + "".join(rng.choices("abcdef", k=4)): 2 for _ in range(200)}
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), size).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, words[a], b, words[b]) for a in words for b in words if near(a, b)}


def test_index_against_plain():
    rng = random.Random(3)
    for _ in range(300):
        words = list({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(60)})
        index = spelling.Index()
        for w in words:
            index.add(w)
        q = "".join(rng.choices("abc", k=rng.randint(1, 7)))
        assert sorted(w for _, w in index.near(q)) == sorted(w for w in words if near(q, w))

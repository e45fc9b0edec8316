"""The pipeline's stages against plain versions, on the small table."""

import importlib

import pytest

from tidemark.llm import quality, secret_scan

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    pipe = importlib.import_module("corpus_pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)


def test_quality_drops_what_it_rejects(spark, stages):
    _, before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(before, model).where("kept").collect()}
    assert set(texts(after)) == kept
    assert not any(brute.rules(t)[0] < 20 for t in texts(after).values())


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    assert set(texts(after)) == {d for d, (_, c) in brute.groups(texts(before)).items() if d == c}


def test_no_passage_repeats(stages):
    _, before, after = stages[2]
    want = brute.removed(texts(before))
    left = texts(after)
    assert {d: brute.words(t) for d, t in left.items()} == {d: w for d, w in want.items() if w or not brute.words(texts(before)[d])}


def test_no_secret_stays(stages):
    _, before, after = stages[3]
    left = texts(after)
    assert set(left) == set(texts(before)) and all(not secret_scan.scan(t or "")[0] for t in left.values())
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)


def test_all_documents_are_packed(stages):
    _, before, after = stages[4]
    by = {}
    for r in after.collect():
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by) == set(texts(before))
    for own in by.values():
        assert sum(n for _, n, _ in own) == own[0][2]


def test_run_gives_the_last_stage(spark, stages):
    pipe = importlib.import_module("corpus_pipeline")
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: sorted(tuple(r[c] for c in order if c in ("doc_id", "doc_tokens")) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(pipe.run(spark, SF)) == key(stages[-1][2])


def test_stages_with_nulls_empty_tables_and_clashing_names(spark):
    """Null ids and texts, repeated rows, other columns with names that operators use; then no rows at all."""
    pipe = importlib.import_module("corpus_pipeline")
    good = "This is a plain and useful text about {0} gardens and the many ways in which people of all ages have cared for them over the years, written for readers who like {0} stories."
    rows = [(1, good.format("rose")), (1, good.format("rose")), (2, None), (3, ""), (None, good.format("water")), (4, good.format("rock") + " password = hunter22hunter22 " + " ".join(f"u{i}" for i in range(30)))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, block int, removed int, node int, label int")
    for own in (docs, docs.limit(0)):
        for name, stage in pipe.STAGES:
            out = stage(spark, own, SF)
            assert name == "packing" or out.columns == docs.columns
            own = spark.createDataFrame(out.collect(), out.schema)
        assert own.where("length < 1").count() == 0


def test_tables_between_stages_are_deleted(spark):
    from tidemark.llm import common

    with common.Tables() as tables:
        a, b = (common.written(spark.range(3), "some") for _ in range(2))
        tables.clear_but_last(spark)
        assert len(tables) == 1 and b.count() == 3
    with pytest.raises(Exception):
        a.count()


def test_runs_side_by_side_keep_their_tables(spark):
    """A run clears its own tables only; tables outside of runs stay."""
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.llm.common import Tables, written

    outside = written(spark.range(3), "outside")

    def run(n):
        with Tables() as tables:
            for k in range(4):
                last = written(spark.range(n + k), "inside")
                tables.clear_but_last(spark)
            return len(tables), last.count()

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(run, [10, 20, 30])) == [(1, 13), (1, 23), (1, 33)]
    assert outside.count() == 3

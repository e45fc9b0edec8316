"""Streams against batch results, on replays, restarts, late rows and closing."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources.io import fresh
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def transactions(spark):
    rng = random.Random(1)
    rows = [(s, float(rng.randrange(-50, 100)), date(2020, 1, 1) + timedelta(rng.randrange(300))) for s in range(600) for _ in range(rng.randrange(1, 9))]
    return spark.createDataFrame(rows, "id long, amount double, date date").cache()


def batch_of(rows):
    return {(r.id, r.n, r.total, r.last) for r in rows.groupBy("id").agg(*map(F.expr, streams.SHOPPER_FEATURES)).collect()}


def in_shuffled_chunks(rows, folder, shift, chunks=6):
    """Rows by shopper, each up to `shift` shoppers out of place, written chunk by chunk."""
    at = F.col("id") + F.pmod(F.xxhash64("id", "amount", "date"), F.lit(2 * shift + 1)) - shift
    held = rows.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(chunks - 1), F.floor(at / (600 / chunks))))).cache()
    for k in range(chunks):
        held.where(F.col("k") == k).drop("k").orderBy(F.rand(k)).write.parquet(f"{folder}/chunk={k}")


def test_shoppers_end_once_and_state_is_bounded(spark, transactions):
    folder = fresh(spark, "chunks")
    in_shuffled_chunks(transactions, folder, 20)
    out, progress = streams.shopper_state(spark, folder, transactions.schema, delay=220)
    rows = [tuple(r) for r in out.select("id", "n", "total", "last").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == batch_of(transactions)
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 0
    assert state[-1]["numRowsTotal"] <= 1  # the mark


def test_shoppers_go_on_from_a_checkpoint(spark, transactions):
    """Three runs, each as new chunks have come; only shoppers near the end are held; a row that comes too late is dropped and counted."""
    path, checkpoint, folder = fresh(spark, "out"), fresh(spark, "checkpoint"), fresh(spark, "chunks")
    held = []
    for k in range(3):
        transactions.where(F.col("id").between(200 * k, 200 * k + 199)).write.parquet(f"{folder}/chunk={k}")
        out, progress = streams.shopper_state(spark, folder, transactions.schema, 5, path, checkpoint, close=False)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1:]
        early = {r.id for r in out.collect()}
        assert early == set(range(200 * k + 199 - 5)) or early == set(range(200 * k + 199 - 5 + 1))
    assert max(held) <= 12
    transactions.where("id = 3").write.parquet(f"{folder}/chunk=9")
    out, progress = streams.shopper_state(spark, folder, transactions.schema, 5, path, checkpoint)
    rows = [tuple(r) for r in out.select("id", "n", "total", "last").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == batch_of(transactions)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) > 0


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_totals_write_what_changed_and_take_replays(spark):
    path = fresh(spark, "totals")
    kept = streams.Totals(spark, path, ["k"], {"n": "1L", "v": "v"}, every=3)
    batches = [spark.createDataFrame([(f"k{j}" if j % 7 else None, j * i) for j in range(0, 40, i + 1)], "k string, v long") for i in range(8)]
    whole = batches[0].limit(0)
    assert kept.read(whole).count() == 0
    for i, b in enumerate(batches):
        kept.add(b, i)
        kept.settle()
        kept.add(b, i)  # again, as after a lost driver
        whole = whole.union(b)
        assert rows_of(kept.read(whole)) == rows_of(whole.groupBy("k").agg(F.count("*"), F.sum("v")))
        written = spark.read.parquet(f"{path}/batches/batch={i}").count()
        assert written == b.select("k").distinct().count()
    kept.add(batches[1], 1)  # long merged
    assert kept._numbers("merged") == [2, 5] and kept._numbers("batches") == list(range(8))
    assert rows_of(kept.read(whole)) == rows_of(whole.groupBy("k").agg(F.count("*"), F.sum("v")))
    again = streams.Totals(spark, path, ["k"], kept.totals, every=3)  # another driver
    assert rows_of(again.read(whole)) == rows_of(kept.read(whole))


def test_rows_of_chunks_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(600).repartition(3).mapInPandas(count, "id long")
    path = streams.in_chunks(rows, "id", 6, "once")
    assert spark.read.parquet(path).count() == 600 and made.value == 600

"""The partitioned index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours


def clustered(rng, n, d, centres):
    return np.round(centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.6, 1)


@pytest.mark.parametrize(("n", "m", "d"), [(300, 40, 3), (24_000, 300, 4), (3, 5, 2)])
def test_equal_to_brute_force_on_ties(spark, n, m, d):
    """A third of train is one point, coordinates are rounded so that distances tie, and train may have fewer rows than k."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(60, d)) * 10
    x, q, y = clustered(rng, n, d, centres), clustered(rng, m, d, centres), rng.integers(0, 3, n)
    x[: n // 3], q[0] = x[0], x[0]
    f = [f"f{i}" for i in range(d)]
    train = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], ["id", "label", *f])
    test = spark.createDataFrame([(i, *map(float, q[i])) for i in range(m)], ["id", *f])
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    want = np.argsort(far, axis=1, kind="stable")[:, :5]
    found = neighbours.candidates(train, test, "id", f, 5, ["label"]).cache()
    nth = F.row_number().over(neighbours.Window.partitionBy("id").orderBy("far", "other"))
    got = {}
    for r in found.withColumn("place", nth).where("place <= 5").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.other, r.label, round(r.far, 9)))
    assert got == {i: [(int(j), int(y[j]), round(float(far[i, j]), 9)) for j in want[i]] for i in range(m)}
    if n > 20_000:
        assert found.agg(F.sum("computed")).first()[0] < 0.1 * n * m


def test_votes_without_the_row_itself(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 2)), rng.integers(0, 3, 200)
    rows = spark.createDataFrame([(f"k{i:03d}", int(y[i]), *map(float, x[i])) for i in range(200)], "id string, label long, a double, b double")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :4]
    for by_distance in (False, True):
        votes = [np.bincount(y[n], 1 / (far[i, n] + 1e-12) if by_distance else np.ones(4), 3).argmax() for i, n in enumerate(near)]
        got = {r.id: r.prediction for r in neighbours.knn(rows, rows, "id", ["a", "b"], "label", 4, by_distance, skip_own=True).collect()}
        assert got == {f"k{i:03d}": int(v) for i, v in enumerate(votes)}


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "id long, label long, a double")
    assert neighbours.knn(rows.limit(0), rows, "id", ["a"], "label", 3).count() == 0
    assert neighbours.knn(rows, rows.limit(0), "id", ["a"], "label", 3).count() == 0
    with pytest.raises(Exception, match="null"):
        neighbours.knn(rows, rows.withColumn("a", F.lit(None).cast("double")), "id", ["a"], "label", 3).collect()


def test_visits_come_in_bounded_batches():
    """Queries that can have neighbours in all of many cells: a batch of them gives no more visits at once than the bound."""
    import pandas as pd

    rng = np.random.default_rng(1)
    cells = neighbours.Cells(rng.normal(size=(200, 16)), np.full(200, 50), np.full(200, 1.0), np.full(200, 9.0))
    asked = pd.DataFrame({"id": np.arange(1000), "v": list(rng.normal(size=(1000, 16))), "reach": 100.0})
    sizes = [len(pdf) for pdf in neighbours._visits(iter([asked]), cells, "id", 5, False)]
    assert 0 < max(sizes) <= 2 * neighbours.VISITS and sum(sizes) >= 1000 * 199


def test_blocks_meet_without_a_row_for_each_query_and_ring(spark, monkeypatch):
    """Without clusters nearly all rings are asked: what is exchanged are blocks of rows and the nearest found, not queries by rings."""
    for name, value in (("ASKING", 50), ("BLOCK", 100), ("BLOCKS", 2), ("PAIRS", 1000)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    x, y = np.round(rng.normal(size=(700, 8)), 1), rng.integers(0, 4, 700)
    x[100:140] = x[0]
    f = [f"f{i}" for i in range(8)]
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(700)], ["id", "label", *f]).repartition(3)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    found = neighbours.nearest(rows, rows, "id", f, 5, ["label"], skip_own=True)
    got = {}
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.other, r.label))
    assert got == {i: [(int(j), int(y[j])) for j in np.argsort(far[i], kind="stable")[:5]] for i in range(700)}
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()

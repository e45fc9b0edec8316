"""Singular vectors, elimination and p-values against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dense, metrics


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts)


@pytest.mark.parametrize(("n", "d", "k", "rank"), [(500, 2000, 12, None), (400, 30, 30, None), (300, 40, 5, 3), (60, 8, 3, None)])
def test_svd_of_wide_tables(spark, n, d, k, rank):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, rank or min(n, d))) @ (rng.normal(size=(rank or min(n, d), d)) * np.geomspace(1, 30, d)) + 100
    out, values, vectors = dense.svd(table(spark, x), "id", F.col("v"), k, most_columns=80)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    k = min(k, rank or k)
    assert np.allclose(values[:k], s[:k], rtol=1e-6) and (values[k:] < 1e-4 * s[0]).all()
    want = (x - x.mean(axis=0)) @ (vt[:k] * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]).T
    got = np.array([r.components[:k] for r in out.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-6 * s[0])


def test_sums_over_many_tasks(spark):
    x = np.arange(600.0).reshape(200, 3)
    df = table(spark, x, 50)
    got = dense.summed(df, lambda batches: sum((np.stack(p["v"]).sum(axis=0) for p in batches if len(p)), np.zeros(3)), fan=4)
    assert got.tolist() == x.sum(axis=0).tolist()


def gini(y, p, tie):
    """Normalised, by its definition over sorted rows."""

    def one(v):
        order = sorted(range(len(y)), key=lambda i: (-v[i], tie[i]))
        share, loss = np.arange(1, len(y) + 1) / len(y), np.cumsum(y[order]) / y.sum()
        return float((loss[1:] * share[:-1] - loss[:-1] * share[1:]).sum())

    return one(p) / one(y)


@pytest.mark.parametrize("d", [4, 11])
def test_elimination_equals_refits(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) * rng.uniform(0.5, 5, d) + rng.uniform(-50, 50, d)
    x[:, 1] = x[:, 0] + rng.normal(size=300) * 0.5
    y = x @ rng.normal(size=d) + rng.normal(size=300) * 5
    y = np.maximum(0, y - np.median(y))
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, i % 3, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", "fold", *names, "y"]).repartition(4)
    own, means = dense.grams(df, names, "y", "fold", 3)
    for k in range(3):
        train = np.arange(300) % 3 != k
        for kept, weights in dense.eliminated(own.sum(axis=0) - own[k], means):
            want = np.linalg.lstsq(np.c_[np.ones(train.sum()), x[train][:, kept]], y[train], rcond=None)[0]
            assert np.allclose(weights[[0, *[1 + i for i in kept]]], want, rtol=1e-6, atol=1e-6)
    got = {r.n_features: (r.features.split(","), r.gini) for r in dense.select_rfe(df, names, "y", "fold", 3, "id").collect()}
    assert sorted(got) == list(range(1, d + 1)) and all(set(got[n][0]) < set(got[n + 1][0]) for n in range(1, d))
    steps = [dense.eliminated(own.sum(axis=0) - own[k], means) for k in range(3)]
    for n in got:
        p = np.array([np.r_[1, x[i]] @ steps[i % 3][d - n][1] for i in range(300)])
        assert got[n][1] == pytest.approx(gini(y, p, range(300)), abs=1e-9)


def by_quadrature(r, n):
    """Share of the density cos(angle) ** (n - 3) beyond asin(r), by Gauss-Legendre on pieces."""
    t, w = np.polynomial.legendre.leggauss(60)

    def area(a, b):
        edges = np.linspace(a, b, 400)
        mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
        x = mid[:, None] + half[:, None] * t
        return float((np.exp((n - 3) * np.log(np.maximum(np.cos(x), 1e-320))) * w * half[:, None]).sum())

    top = min(math.pi / 2, 40 / math.sqrt(n - 2))
    low = math.asin(r)
    return area(low, top) / area(0, top) if low < top else 0.0


def test_p_values(spark):
    rows = [(float(r), n) for n in (3, 4, 5, 7, 10, 30, 100, 1000, 10**4, 10**5, 10**6) for r in [*np.linspace(0, 0.999, 25), 0.001, 0.003, 0.01]]
    df = spark.createDataFrame(rows, "r double, n long")
    for r in df.select("*", metrics.p_value(F.col("r"), F.col("n")).alias("p"), metrics.p_value(-F.col("r"), F.col("n")).alias("q")).collect():
        assert abs(r.p - by_quadrature(r.r, r.n)) < 1e-10 and r.p == r.q, r
    edge = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.5, 2), (None, 9), (0.5, None)], "r double, n long").select(metrics.p_value(F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in edge] == [0.0, 0.0, None, None, None]


def test_linear_family_is_scored_on_rows_not_seen(spark):
    """Weights equal to Spark ML's; errors and the weighted Gini are those of folds that the models were not fitted on."""
    from tidemark.operators import models

    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(300, 3)) * [1, 5, 0.2] + 3, rng.uniform(1, 4, 300)
    y = np.maximum(0, x @ [2.0, -1.0, 0.0] + rng.normal(size=300) * 3)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, i % 5, *map(float, r), float(u), float(v)) for i, (r, u, v) in enumerate(zip(x, w, y, strict=True))], ["id", "fold", *names, "w", "y"]).repartition(4)
    kinds = {"ordinary": (0.0, 0.0), "lasso": (0.8, 1.0), "elastic": (0.8, 0.5)}
    got = {r.kind: r for r in dense.linear_family(df, names, "y", "fold", 5, kinds, "id", "w").collect()}
    own, means = dense.grams(df, names, "y", "fold", 5)

    def gini(p, k):
        def one(by):
            order = sorted(np.flatnonzero(np.arange(300) % 5 == k), key=lambda i: (-by[i], i))
            r, c = np.cumsum(w[order]) / w[order].sum(), np.cumsum((w * y)[order]) / (w * y)[order].sum()
            return (c[1:] * r[:-1] - c[:-1] * r[1:]).sum()

        return one(p) / one(y)

    for kind, how in kinds.items():
        p = np.empty(300)
        for k in range(5):
            found = models.pipeline(names, models.linear("y", kind, 0.8)).fit(df.where(F.col("fold") != k)).stages[-1]
            weights = dense.penalised(own.sum(axis=0) - own[k], means, *how)
            assert np.allclose(weights, [found.intercept, *found.coefficients], atol=2e-4), kind
            p[k::5] = np.c_[np.ones(60), x[k::5]] @ weights
        scores = np.array([gini(p, k) for k in range(5)])
        assert got[kind].mae == pytest.approx(np.abs(y - p).mean()) and got[kind].gini == pytest.approx(scores.mean()) and got[kind].gini_cv == pytest.approx(scores.std() / scores.mean())


def test_ranking_exchanges_rows_once_and_labels_are_ranked_by_value(spark, monkeypatch):
    """Elimination's Gini over many ranges, with heavy ties, equals the plain one; rows are exchanged by range, never through a window of their own."""
    from tidemark.operators import prefix

    rng = np.random.default_rng(4)
    y, p, w = rng.choice([0.0, 0.0, 1.5, 7.0], 3000), rng.choice([0.1, 0.1, 0.2, 0.7], 3000), np.ones(3000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y double, p double").repartition(5)
    monkeypatch.setattr(prefix, "RANKED", 100)
    found = prefix.lorenz_gini(df, "y", "p", tie=["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window [" in x)
    assert "part#" in window and plan.count("RepartitionByExpression") == 1
    value = prefix.gini_normalized(df, "y", "p", tie=["id"]).first()[0]
    assert value == pytest.approx(gini(y, p, range(3000)), abs=1e-12)

"""Models, components and order statistics against NumPy or on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, metrics, models, prefix, prep, search
from tidemark.plans import model_queries
from tidemark.plans.recast import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 4.0, 0.3] + [5.0, 0.0, -2.0]
    y = 3 + x @ [2.0, -1.0, 0.5] + rng.normal(size=400)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()


def test_ordinary_least_squares(table):
    x, y, df = table
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    found = models.pipeline(["a", "b", "c"], models.linear("y", "ordinary", 0)).fit(df).stages[-1]
    assert np.allclose([found.intercept, *found.coefficients], want, atol=1e-4)
    own = models.ridge_weights(df, ["a", "b", "c"], "y", 0.0)
    assert np.allclose([own["one"], own["a"], own["b"], own["c"]], want, atol=1e-8)


def test_ridge_is_penalised_and_weighted(table):
    x, y, df = table
    w = 1 + np.arange(400) % 3
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    want = np.linalg.solve((xc * w[:, None]).T @ xc + 50 * np.eye(3), (xc * w[:, None]).T @ yc)
    own = models.ridge_weights(df.withColumn("w", 1 + F.col("id") % 3), ["a", "b", "c"], "y", 50.0, "w")
    assert np.allclose([own["a"], own["b"], own["c"]], want)


def test_lasso_drops_and_elastic_shrinks(table):
    _, _, df = table
    size = lambda kind, alpha: [abs(v) for v in models.pipeline(["a", "b", "c"], models.linear("y", kind, alpha)).fit(df).stages[-1].coefficients]
    lasso, plain = size("lasso", 1.5), size("ordinary", 0)
    assert lasso[2] == 0 and lasso[1] < plain[1] and sum(size("elastic", 1.0)) < sum(plain)


def test_quantile_beats_its_start(table):
    _, y, df = table
    scaled = prep.scale_standard(df, ["a", "b", "c"])
    w = models.quantile_linear(scaled, "y", ["a", "b", "c"], 0.7)
    rows = scaled.orderBy("id").toPandas()
    error = rows.y.to_numpy() - (w[0] + rows[["a", "b", "c"]].to_numpy() @ np.array(w[1:]))
    pinball = lambda e: np.maximum(0.7 * e, -0.3 * e).mean()
    assert pinball(error) < 0.5 * pinball(y - np.quantile(y, 0.7)) and abs((error <= 0).mean() - 0.7) < 0.1


@pytest.mark.parametrize("loss", [models.SQUARED, models.ABSOLUTE])
def test_boosting_with_losses_and_shares(table, loss):
    _, y, df = table
    learners = {"linear": lambda c: models.linear(c, "ordinary", 0), "tree": lambda c: models.regressor("forest", c, numTrees=3, maxDepth=3)}
    boosted = models.boost_mixed(df, "y", ["a", "b", "c"], learners, "id", rounds=3, shrinkage=1.0, loss=loss, share=0.7)
    got = models.boost_predict(df, boosted, "id").orderBy("id").toPandas()
    assert boosted[0] == pytest.approx(np.mean(y) if loss is models.SQUARED else np.median(y))
    assert np.abs(got.y - got.prediction).mean() < 0.5 * np.abs(y - np.median(y)).mean()


def test_steps_of_boosting_are_minima(spark):
    """Of a convex loss along a line, against a fine grid; squares in closed form."""
    rng = np.random.default_rng(8)
    y, p, h = rng.normal(size=500) * 3, rng.normal(size=500), rng.normal(size=500)
    h += (y - p) * 0.3
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, p, h, strict=True)], "__y double, __p double, __h double")
    grid = np.linspace(-1, 10, 20001)
    for loss, mean in ((models.SQUARED, lambda e: (e * e).mean()), (models.ABSOLUTE, lambda e: np.abs(e).mean())):
        values = [mean(y - p - t * h) for t in grid]
        step, value = models.best_step(df, loss)
        assert value == pytest.approx(mean(y - p - step * h)) and value <= min(values) * (1 + 2e-4)


@pytest.mark.parametrize("whiten", [False, True])
def test_components(spark, whiten):
    rows = view(spark, SF, "embeddings")
    e = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], dtype=float)
    centred = e - e.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    share = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(share), 0.85) + 1)
    flat = rows.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    out, explained = models.pca_reduce(flat, "vec_id", [f"f{i}" for i in range(64)], share=0.85, whiten=whiten)
    got = np.array([r.components for r in out.orderBy("vec_id").collect()])
    want = centred @ (vt[:k] * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]).T
    assert np.allclose(explained, share[:k], atol=1e-9) and got.shape == want.shape
    assert np.allclose(got, want / want.std(axis=0, ddof=1) if whiten else want, atol=1e-6)


def test_component_queries(spark):
    k, explained = model_queries.QUERIES["variance_cutoff"](spark, SF).first()
    rows = view(spark, SF, "embeddings")
    e = np.array([r.embedding for r in rows.collect()], dtype=float)
    share = np.linalg.svd(e - e.mean(axis=0), compute_uv=False) ** 2
    share = np.cumsum(share / share.sum())
    assert share[k - 2] <= 0.5 < share[k - 1] and explained == pytest.approx(share[k - 1])
    assert model_queries.QUERIES["svd_components"](spark, SF).count() == 20 * len(e)
    assert model_queries.QUERIES["pca_reduce"](spark, SF).groupBy("component").agg(F.stddev_samp("value").alias("s")).where("abs(s - 1) > 1e-6").count() == 0


@pytest.mark.parametrize("name", ["model_logistic", "model_random_forest", "model_gbt_classifier", "model_mlp", "model_svm", "baseline_first_forest"])
def test_classifiers_beat_the_majority(spark, name):
    got = model_queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == view(spark, "/root/testdata/sf0.01", "passengers").count() and set(got.prediction) <= {0.0, 1.0}
    assert (got.prediction == got.survived).mean() > max(got.survived.mean(), 1 - got.survived.mean()) + 0.1


def test_regressors_and_selection(spark):
    got = model_queries.QUERIES["model_gbt_regressor"](spark, SF).toPandas()
    assert np.abs(got.target - got.prediction).mean() <= np.abs(got.target - got.target.mean()).mean()
    mixed = model_queries.QUERIES["model_boost_mixed"](spark, SF).toPandas()
    assert ((mixed.target - mixed.prediction) ** 2).mean() < mixed.target.var()
    family = {r.kind: r.mae for r in model_queries.QUERIES["model_linear_family"](spark, SF).collect()}
    assert set(family) == {"ordinary", "lasso", "elastic"} and all(v > 0 for v in family.values())
    weights = model_queries.QUERIES["model_importance"](spark, SF).toPandas()
    assert weights["mean"].sum() == pytest.approx(1) and (weights["mean"] >= 0).all()
    steps = [r.features.split(",") for r in model_queries.QUERIES["select_rfe"](spark, SF).orderBy(F.desc("n_features")).collect()]
    assert [len(s) for s in steps] == [4, 3, 2, 1] and all(set(b) < set(a) for a, b in zip(steps, steps[1:], strict=False))
    top = model_queries.QUERIES["select_top25_by_forest"](spark, SF).collect()
    assert len(top) == 25 and [r["mean"] for r in top] == sorted((r["mean"] for r in top), reverse=True)
    quantile = model_queries.QUERIES["model_quantile_linear"](spark, SF).toPandas()
    pinball = lambda e: np.maximum(0.8 * e, -0.2 * e).mean()
    assert pinball(quantile.target - quantile.prediction) < pinball(quantile.target - np.quantile(quantile.target, 0.8)) and abs((quantile.target <= quantile.prediction).mean() - 0.8) < 0.05


def test_pipeline_grid(spark, table):
    _, _, df = table
    made, found = models.make_pipeline({"fields": models.assembled(["a", "b"]), "model": models.linear("y", "lasso", 1.0)}, {"model__regParam": [0.1, 0.2], "model__maxIter": [5, 10]})
    assert len(found) == 4 and models.configured(made, found[3]).getStages()[1].getRegParam() == 0.2 and made.getStages()[1].getRegParam() == 1.0
    assert models.configured(made, found[0]).fit(df).transform(df).count() == 400
    with pytest.raises(ValueError):
        models.make_pipeline({"model": models.linear("y", "lasso", 1.0)}, {"model__nothing": [1]})


def test_genetic_search_draws_and_keeps_scores():
    seen = []

    def score(p):
        seen.append(tuple(p.values()))
        return None if p["a"] == 2 else p["a"] * 10 + p["b"]

    best, value, scores = search.search_genetic(score, {"a": [0, 1, 2, 3], "b": list(range(5))}, population=8, steps=20)
    assert best == {"a": 3, "b": 4} and value == 34 and len(seen) == len(set(seen)) == len(scores)


def test_order_statistics_with_skew(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(4000) < 0.97, 0.0, np.round(rng.normal(size=4000), 2))
    g = np.where(rng.random(4000) < 0.99, "x", rng.choice(["y", "z"], 4000))
    df = spark.createDataFrame([(str(a), float(b) if i % 11 else None) for i, (a, b) in enumerate(zip(g, v, strict=True))] + [("none", None)], "g string, v double")
    at = (0.0, 0.1, 25.0, 50.0, 97.5, 99.0, 100.0)
    got = {r.g: [r[f"p{str(x).replace('.', '_')}"] for x in at] for r in aggregates.percentiles(df, "v", at, ["g"]).collect()}
    held = v[np.arange(4000) % 11 > 0], g[np.arange(4000) % 11 > 0]
    for k in ("x", "y", "z"):
        assert np.allclose(got[k], np.percentile(held[0][held[1] == k], at))
    assert got["none"] == [None] * len(at)
    assert prefix.most_frequent(df, "v").first()["mode"] == 0.0
    assert prefix.most_frequent(df.where("v is null"), "v").collect() in ([], [(None,)])
    one = prep.fit_fill(df.withColumn("w", -F.col("v")), ["v", "w"], "median").first()
    assert (one["v"], one["w"]) == (0.0, 0.0)


def test_heavy_values_are_cut_by_their_ties(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 33 == 0, F.col("id") % 7 + 1.0).otherwise(0.0).alias("v"), F.lit(1).cast("long").alias("n"))
    out = prefix.global_prefix_sum(df, "v", ["n"], descending=True, tie=["id"])
    rows = sorted(((r.v, r.id, r.before_n) for r in out.collect()), key=lambda r: (-r[0], r[1]))
    assert [r[2] for r in rows] == list(range(20000))
    cuts, heavy = prefix.ranges(df, "v", 8)
    assert heavy == [0.0] and cuts == [0.0]
    big = df.withColumn("v", F.lit(5.0))
    assert sorted(r.before_n for r in prefix.global_prefix_sum(big, "v", ["n"], tie=["id"]).select("before_n").collect()) == list(range(20000))


def test_heavy_values_are_cut_by_text_ties(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 50 > 0, F.format_string("k%05d", "id")).alias("k"), F.when(F.col("id") % 33 == 0, F.col("id") % 7 + 1.0).otherwise(0.0).alias("v"), F.lit(1).cast("long").alias("n"))
    rows = prefix.global_prefix_sum(df.where("k IS NOT NULL"), "v", ["n"], tie=["k"]).collect()
    assert [r.before_n for r in sorted(rows, key=lambda r: (r.v, r.k))] == list(range(len(rows)))
    assert sorted(r.before_n for r in prefix.global_prefix_sum(df, "v", ["n"], tie=["k"]).select("before_n").collect()) == list(range(6000))


def test_stratified_splits_with_one_large_class(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise(F.when(F.col("id") % 101 != 0, F.lit("most"))).alias("y"))
    n = {r.y: (r.n, r.t) for r in prep.split_stratified(df, "y", "id", 0.3).groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect()}
    assert set(n) == {"rare", "most", None} and all(t == round(k * 0.3) for k, t in n.values()) and sum(k for k, _ in n.values()) == 5000
    folds = prep.cv_stratified_kfold(df, "y", "id", 5).groupBy("y", "fold").count().toPandas()
    assert folds.groupby("y", dropna=False)["count"].agg(lambda c: c.max() - c.min()).max() <= 1


def test_integerize_long_dictionary(spark):
    df = spark.range(3000).select(F.concat(F.lit("same-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    codes = {r.k: r.code for r in prefix.integerize([df, df.limit(10)], "k").collect()}
    assert codes == {f"same-{i:05d}": i for i in range(3000)}
    assert prefix.integerize([df.limit(0)], "k").count() == 0


def test_image_files(spark, tmp_path):
    from tidemark.plans import io_queries
    from tidemark.sources import io

    files = spark.createDataFrame([("a/1.bmp", io_queries._BMP + bytes(range(192))), ("b/2.bmp", b"no"), ("b/3.bmp", io_queries._BMP + bytes(192))], "path string, content binary")
    assert io.write_files(files, str(tmp_path)) == 3
    good, bad = io.read_images_labelled(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r["class"], r.height, r.width) for r in good.collect()} == {("1.bmp", "a", 8, 8), ("3.bmp", "b", 8, 8)}
    assert [r.message for r in bad.collect()] == ["not an image: 2.bmp"]
    assert io.read_images_labelled(spark, str(tmp_path), files.where("path like 'a/%'"))[0].count() == 1
    assert metrics.accuracy("a", "b") is not None


def test_fits_read_one_table_and_not_the_join(spark):
    from tidemark.plans import model_queries
    from tidemark.plans.recast import view

    read = lambda n: view(spark, "/root/testdata/sf0.001", n)
    assert not [f for f in model_queries._loss(read).inputFiles() if "lineitem.parquet" in f or "part.parquet" in f]
    rows = model_queries._passengers(read)
    files = [f for f in rows.inputFiles() if "customer.parquet" not in f]
    assert len(files) >= spark.sparkContext.defaultParallelism and rows.count() == read("passengers").count()


def test_boosting_by_cells_is_spark_mls(spark):
    """Equal to GBTRegressor where all rows are taken and columns have few values; the query has 1000 trees for both losses."""
    import inspect

    from tidemark.operators import boosting

    rng = np.random.default_rng(2)
    x = np.c_[rng.integers(0, 7, 800), rng.integers(0, 20, 800), rng.integers(0, 3, 800)].astype(float)
    y = x[:, 0] * 3 - (x[:, 1] > 9) * x[:, 2] * 5 + rng.normal(size=800)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", "a", "b", "c", "y"]).repartition(3)
    made = boosting.boost(df, "id", ["a", "b", "c"], "y", trees=6, rate=0.1, share=1.0)
    for loss in ("squared", "absolute"):
        want = models.pipeline(["a", "b", "c"], models.regressor("gbt", "y", maxIter=6, maxDepth=3, stepSize=0.1, lossType=loss)).fit(df).transform(df)
        got = made.predict(want.withColumnRenamed("prediction", "want"), loss).select("want", "prediction").toPandas()
        assert np.allclose(got["want"], got["prediction"], atol=1e-9), loss
    how = {k: p.default for k, p in inspect.signature(boosting.boost).parameters.items()}
    assert how["trees"] == 1000 and how["share"] == 0.9 and set(how["losses"]) == {"squared", "absolute"}
    took = boosting._taken(rng.integers(0, 1 << 62, 20_000).astype(np.uint64), 5, 0.9)
    assert abs(took.mean() - 0.9) < 0.01

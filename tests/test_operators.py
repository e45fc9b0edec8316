import datetime
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, images, metrics, models, online, prefix, prep, relational, search
from tidemark.plans import queries, recast
from tidemark.sources import io


def test_prefix_sum_equals_window(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(20)), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, n long")
    got = {r.id: r.before_n for r in prefix.global_prefix_sum(df, "v", ["n"], tie=["id"]).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += n
    down = {r.id: r.before_n for r in prefix.global_prefix_sum(df, "v", ["n"], descending=True, tie=["id"]).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        assert down[i] == total
        total += n


def test_prefix_sum_of_equal_and_missing_values(spark):
    df = spark.createDataFrame([(i, 1.0, 1) for i in range(50)], "id long, v double, n long")
    assert sorted(r.before_n for r in prefix.global_prefix_sum(df, "v", ["n"], tie=["id"]).collect()) == list(range(50))
    assert prefix.global_prefix_sum(df.limit(0), "v", ["n"]).count() == 0


def test_auc_and_gini(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), rng.randrange(15) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert prefix.auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert prefix.auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0] == pytest.approx(1 - want)
    assert prefix.gini_normalized(df, "y", "y", tie=["id"]).first()[0] == pytest.approx(1)


def test_scalers(spark):
    df = spark.createDataFrame([(i, float(i), 3.0, 0.0) for i in range(20)], "id long, a double, b double, c double")
    r = prep.scale_standard(df, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert (round(r[0], 9), round(r[1], 9), r[2]) == (0, 1, 0)
    r = prep.scale_minmax(df, ["a", "b", "c"]).agg(F.min("a"), F.max("a"), F.max("b"), F.max("c")).first()
    assert tuple(r) == (0, 1, 0, 0)


def test_fill_missing_with_an_empty_column(spark):
    df = spark.createDataFrame([(1, 2.0, None, 4.0), (2, None, None, 8.0)], "id long, a double, b double, c double")
    got = {r.id: (r.a, r.b) for r in prep.fill_missing(df, ["a", "b", "c"]).collect()}
    assert got == {1: (2.0, 3.0), 2: (2.0, 5.0)}


def test_folds_partition_rows(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 7 == 0)
    n = {r.fold: r["count"] for r in prep.cv_stratified_kfold(df, "y", "id", 4).groupBy("fold").count().collect()}
    assert sum(n.values()) == 1000 and max(n.values()) - min(n.values()) <= 2
    assert prep.split_stratified(df, "y", "id", 0.3).where("is_train and y").count() == round(143 * 0.3)


def test_small_checks_its_size(spark):
    assert "broadcast" in relational.small(spark.range(5))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in relational.small(spark.range(50), most=10)._jdf.queryExecution().toString().lower()


def test_semi_or_with_nulls(spark):
    facts = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", None), (4, None, None)], "id long, p string, q string")
    keys = spark.createDataFrame([("a", None), (None, "y")], "p string, q string")
    assert {r.id for r in relational.semi_or(facts, keys, ["p", "q"]).collect()} == {1, 2}


def test_product_of_uniques_checks_its_size(spark):
    df = spark.range(100).withColumn("b", F.col("id"))
    with pytest.raises(ValueError):
        relational.product_of_uniques(df, ["id", "b"], most=100)


def test_group_then_regress_unseen_group(spark):
    train = spark.createDataFrame([(g, float(x), 2.0 * x + g) for g in range(3) for x in range(10)], "g long, x double, y double")
    test = spark.createDataFrame([(1, 5.0), (9, 5.0)], "g long, x double")
    got = {r.g: r.prediction for r in models.group_then_regress(train, test, "g", ["x"], "y").collect()}
    assert got == pytest.approx({1: 11.0, 9: 11.0})


def test_quantile_share_below(spark):
    rng = np.random.default_rng(0)
    x = rng.random(800)
    df = spark.createDataFrame([(float(a), float(3 * a + e)) for a, e in zip(x, rng.random(800), strict=True)], "x double, y double")
    w = models.quantile_linear(df, "y", ["x"], 0.8)
    assert abs(df.where(F.col("y") <= w[0] + w[1] * F.col("x")).count() / 800 - 0.8) < 0.06


def test_boosting_lowers_the_error(spark):
    df = spark.createDataFrame([(i, float(i % 10), float((i % 10) ** 2)) for i in range(200)], "id long, x double, y double")
    learners = {"linear": lambda c: models.linear(c, "ordinary", 0), "forest": lambda c: models.regressor("forest", c, numTrees=3, maxDepth=4)}
    got = models.boost_predict(df, models.boost_mixed(df, "y", ["x"], learners, "id", rounds=3, shrinkage=1.0), "id")
    assert got.agg(metrics.mae(F.col("y"), F.col("prediction"))).first()[0] < 5


def test_genetic_search_finds_the_best():
    calls = []

    def score(p):
        calls.append(tuple(p.values()))
        return -abs(p["a"] - 3) - abs(p["b"] - 4)

    best, value, _ = search.search_genetic(score, {"a": list(range(6)), "b": list(range(6))}, population=10, steps=15)
    assert value >= -1 and len(calls) == len(set(calls))


def test_regions():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 0], [1, 1, 0, 1]], dtype=bool)
    assert images.labelled_regions(mask).max() == 4
    assert images.labelled_regions(np.ones((2, 2), bool)).tolist() == [[1, 1], [1, 1]]
    assert images.resized(np.arange(16.0).reshape(4, 4), 4, 4).tolist() == np.arange(16.0).reshape(4, 4).tolist()
    assert np.allclose(images.resized(np.arange(16.0).reshape(4, 4), 4, 4, 180), np.arange(16.0)[::-1].reshape(4, 4))


def test_empty_and_null_aggregates(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert aggregates.missing_totals(none).count() == 1
    assert metrics.corr_with_target(none, ["v"], "id").first()["abs_r"] is None
    assert math.isclose(aggregates.histogram(spark.createDataFrame([(1.0,), (None,)], "v double"), "v", 0, 1, 4).first()["share"], 1)


def test_best_model_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, y double")
    model = models.pipeline(["x"], models.classifier("tree", "y")).fit(df)
    path = str(tmp_path)
    assert io.save_if_better(model, 0.5, path, spark) == 0.5
    assert io.save_if_better(model, 0.4, path, spark) == 0.5
    assert io.save_if_better(model, 0.9, path, spark) == 0.9


def flood(mask):
    """Labels by flood filling from each pixel, ordered by last pixel."""
    left, groups = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            group.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        groups.append(group)
    label = np.zeros(mask.shape, int)
    for n, group in enumerate(sorted(groups, key=max), 1):
        for p in group:
            label[p] = n
    return label


def test_regions_equal_flood_filling():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random(rng.integers(1, 25, 2)) < rng.choice([0.2, 0.4, 0.6, 0.9])
        assert (images.labelled_regions(mask) == flood(mask)).all()
        outside = flood(~np.pad(mask, 1))
        assert images.filled_area(mask) == (outside != outside[0, 0])[1:-1, 1:-1].sum()


def test_spiral_and_holes():
    n = 201
    mask = np.zeros((n, n), bool)
    y, x, dy, dx, length = n // 2, n // 2, 0, 1, 2
    mask[y, x] = True
    while length < n - 4:
        for _ in range(2):
            for _ in range(length):
                y, x = y + dy, x + dx
                mask[y, x] = True
            dy, dx = dx, -dy
        length += 2
    label = images.labelled_regions(mask)
    assert label.max() == 1 and (label > 0).sum() == mask.sum() and images.filled_area(mask) == mask.sum()
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    assert images.filled_area(ring) == 49 and images.labelled_regions(ring).max() == 2
    assert images.labelled_regions(np.zeros((3, 0), bool)).shape == (3, 0)


def test_weighted_folds_equal_plain_fits(spark):
    """Naive Bayes of each fold from one pass of sums; weights, a class that a fold's training lacks, other columns kept."""
    rng = np.random.default_rng(9)
    n = 240
    y = rng.integers(0, 2, n)
    x, w, fold = rng.normal(size=(n, 2)) + 1.5 * y[:, None], rng.integers(1, 4, n), np.arange(n) % 4
    y[(fold == 2) & (rng.random(n) < 0.05)] = 2
    y[fold != 2] = np.minimum(y[fold != 2], 1)
    y[2] = 2
    df = spark.createDataFrame([(i, int(fold[i]), int(y[i]), float(w[i]), *map(float, x[i])) for i in range(n)], "id long, fold int, y int, w double, a double, b double")
    got = {r.id: r for r in search.bayes_out_of_fold(df, "fold", 4, ["a", "b"], "y", ["id"], "w").collect()}
    for k in range(4):
        train = fold != k
        mean, extra = np.average(x[train], axis=0, weights=w[train]), None
        extra = 1e-9 * np.average((x[train] - mean) ** 2, axis=0, weights=w[train]).max()
        for i in np.flatnonzero(fold == k).tolist():
            lp = np.full(3, -np.inf)
            for c in range(3):
                own = train & (y == c)
                if own.any():
                    m = np.average(x[own], axis=0, weights=w[own])
                    v = np.average((x[own] - m) ** 2, axis=0, weights=w[own]) + extra
                    lp[c] = np.log(w[own].sum() / w[train].sum()) - 0.5 * (((x[i] - m) ** 2) / v + np.log(v)).sum()
            p = np.exp(lp - lp.max()) / np.exp(lp - lp.max()).sum()
            assert np.allclose(got[i].p, p, atol=1e-9) and got[i].prediction == int(p.argmax())


def test_quantile_near_the_optimum_with_texts(spark):
    """Within a hundredth of the optimum of the linear program, found here by reweighted least squares; words of a text count."""
    rng = np.random.default_rng(5)
    for n, d, tau in ((400, 3, 0.7), (1500, 5, 0.9)):
        x = rng.normal(size=(n, d))
        word = rng.integers(0, 3, n)
        y = 3 + x @ rng.normal(size=d) * 2 + 4 * (word == 1) + rng.normal(size=n) * np.exp(x[:, 0] * 0.5)
        names = [f"f{i}" for i in range(d)]
        df = spark.createDataFrame([(*map(float, r), ["red", "Green", None][t], float(v)) for r, t, v in zip(x, word, y, strict=True)], [*names, "text", "y"]).repartition(4)
        full = np.c_[np.ones(n), x, word == 0, word == 1]
        w, soft = np.linalg.lstsq(full, y, rcond=None)[0], 1.0
        for _ in range(1200):
            e = y - full @ w
            a = np.where(e > 0, tau, 1 - tau) / np.maximum(np.abs(e), soft)
            w, soft = np.linalg.solve((full * a[:, None]).T @ full, (full * a[:, None]).T @ y), max(soft * 0.98, 1e-7)
        e = y - full @ w
        found = online.fit_quantile(df, "y", names, tau, words=["text"], bits=14)
        assert found.loss <= 1.01 * np.maximum(tau * e, (tau - 1) * e).mean()
        held = found.predict(df).select("y", "prediction").toPandas()
        e = (held.y - held.prediction).to_numpy()
        assert np.maximum(tau * e, (tau - 1) * e).mean() == pytest.approx(found.loss)


def test_round_binary_is_duckdb_round(spark):
    import duckdb

    from tidemark.functions import scalars

    rng = random.Random(4)
    values = [-1024.1625, -2077.1375, 0.0005, -0.0005, 12.0] + [rng.randrange(-4200, 4200) + rng.randrange(400) / 80 for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalars.round_binary(F.col("v"), 3)).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(v, 3) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert got == want and got[0] == -1024.162


def test_a_sky_is_one_row_of_sums_and_a_crowded_one_is_dealt(spark):
    from tidemark.operators import spatial

    rng = random.Random(5)
    rows = [(s, rng.uniform(0, 4200), rng.uniform(0, 4200), rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(60) for s in (7, 8, 9)] + [(9, 1.0, 2.0, 0.5, 0.25)] * 200 + [(7, None, 1.0, 0.0, 0.0), (None, 1.0, 1.0, 0.0, 0.0), (10, 1.0, None, 0.0, 0.0)]
    skies = spark.createDataFrame(rows, "sky_id long, x double, y double, e1 double, e2 double").repartition(7)
    assert sorted(r.sky_id for r in spatial._kernel_maps(skies, 14, 1000.0).collect()) == [7, 8, 9]
    plain = {(r.sky_id, r.i, r.j): r for r in spatial.grid_kernel_maps(skies).collect()}
    dealt = {(r.sky_id, r.i, r.j): r for r in spatial.grid_kernel_maps(skies, crowded=100).collect()}
    assert len(plain) == 3 * 196 and plain.keys() == dealt.keys()
    for key, r in plain.items():
        assert list(r)[3:] == pytest.approx(list(dealt[key])[3:], abs=1e-12)
    own = [r for r in rows if r[0] == 9]
    w = [math.exp(-((x - 150) ** 2 + (y - 450) ** 2) / 2e6) for _, x, y, _, _ in own]
    assert plain[9, 0, 1].e1_mean == pytest.approx(sum(a * r[3] for a, r in zip(w, own, strict=True)) / sum(w), abs=1e-12)
    assert spatial.grid_kernel_maps(skies.where("sky_id = 10")).count() == 0


def exchanged(df):
    """Bytes that the exchanges of df take, before compression."""

    def of(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return of(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def test_shopper_offer_features_exchange_few_bytes(spark):
    """Without broadcasts by size, as on large tables, a line's row costs 99 bytes of exchanges (387 when texts were exchanged)."""
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken = exchanged(queries.QUERIES["shopper_offer_features"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < taken < 150 * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_lines_and_their_tables_are_the_transactions(spark):
    sf = "/root/testdata/sf0.001"
    v = lambda n: recast.view(spark, sf, n)
    made = v("lines").join(v("baskets"), "basket").join(v("products"), "product").join(v("sellers"), "seller")
    columns = ["id", "chain", "category", "company", "brand", "date", "quantity", "amount"]
    a, b = made.select(columns), v("transactions").select(columns)
    assert a.count() and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def plain_features(rows, history, offers, sets, spans):
    """num, amt and quant of each set and span, and the number of all rows, row by row."""
    out = {}
    for i, chain, *values, date, amount, quantity in rows:
        for h in (h for h in history if h[0] == i):
            kept = out.setdefault(i, {"all": 0} | {(f, s): [0, 0.0, 0.0] for f in sets for s in (None, *spans)})
            kept["all"] += 1
            asked = dict(zip(("chain", "category", "company", "brand"), (h[1], *next((o[1:] for o in offers if o[0] == h[2]), (None,) * 3))))
            own, ago = dict(zip(asked, (chain, *values))), (h[3] - date).days if date else None
            for f, s in ((f, s) for f in sets for s in (None, *spans)):
                if all(own[c] is not None and own[c] == asked[c] for c in f) and (s is None or ago is not None and 0 <= ago <= s):
                    for place, x in enumerate((1, amount or 0, quantity or 0)):
                        kept[f, s][place] += x
    return out


@pytest.mark.parametrize("most", [1 << 62, 1])
def test_shopper_offer_features_in_all_forms(spark, most, monkeypatch):
    """Missing values, offers and dates, an id twice in history, spans out of order: rows, and rows by basket and product, with one code and three."""
    monkeypatch.setattr(aggregates, "WORD", most)
    rng, day = random.Random(5), datetime.date(2020, 1, 1)
    pick = lambda *xs: rng.choice(xs)
    baskets = [(b, rng.randrange(6), day + datetime.timedelta(rng.randrange(-50, 10)) if b % 9 else None) for b in range(60)]
    products = [(p, pick("a", "b", None, "z"), pick("a", "c", None), pick("x", "y", "")) for p in range(25)]
    lines = [(rng.randrange(62), rng.randrange(25), pick(1, 2, None), pick(1.5, -2.0, None), pick(1.0, 3.0, None)) for _ in range(400)]
    offers = [(o, pick("a", "b", None), pick("a", "c", "d"), pick("x", "", None)) for o in range(4)]
    history = [(i, pick(1, 2), pick(0, 1, 2, 3, 7), day) for i in (0, 1, 2, 3, 3, 4)]
    rows = [(baskets[b][1], c, *products[p][1:], baskets[b][2], a, q) for b, p, c, a, q in lines if b < 60]
    kinds = "category string, company string, brand string"
    rest = [spark.createDataFrame(history, "id long, chain int, offer long, offerdate date"), spark.createDataFrame(offers, f"offer long, {kinds}")]
    sets, spans = (("chain",), ("brand",), ("brand", "category"), ("category", "company", "brand")), (30, 7)
    keyed = spark.createDataFrame(lines, "basket long, product long, chain int, amount double, quantity double")
    by_basket, by_product = spark.createDataFrame(baskets, "basket long, id long, date date"), spark.createDataFrame(products, f"product long, {kinds}")
    whole = spark.createDataFrame(rows, f"id long, chain int, {kinds}, date date, amount double, quantity double")
    want = plain_features(rows, history, offers, sets, spans)
    forms = [(keyed, {"baskets": by_basket, "products": by_product}), (whole, {}), (keyed.join(by_basket, "basket"), {"products": by_product})]
    for transactions, tables in forms if most > 1 else forms[:1]:
        got = {r.id: r for r in aggregates.shopper_offer_features(transactions, *rest, sets, spans, **tables).collect()}
        assert got.keys() == want.keys()
        for i, kept in want.items():
            for f, s in ((f, s) for f in sets for s in (None, *spans)):
                tag, (num, amt, quant) = "_".join(f) + (f"_{s}" if s else ""), kept[f, s]
                assert [got[i][f"{tag}_{x}"] for x in ("num", "freq", "has", "never", "amt", "quant")] == [num, num / kept["all"], num > 0, num == 0, amt, quant]


def test_sampled_types_come_from_the_head_of_a_file(tmp_path):
    """On executors of their own, a file of many splits: rows of another split may arrive before the header."""
    (tmp_path / "t.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(20_000)))
    text = f"""
from pyspark.sql import SparkSession
from tidemark.sources import io
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1024m").config("spark.ui.enabled", "false").config("spark.sql.files.maxPartitionBytes", "4k").config("spark.sql.files.openCostInBytes", "0").getOrCreate()
for _ in range(4):
    rows = io.read_csv_sampled(spark, "{tmp_path}/t.csv")
    assert rows.dtypes == [("id", "int"), ("name", "string")], rows.dtypes
assert rows.count() == 20_000
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", text], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_quantile_rows_are_packed_once_and_learners_take_their_steps_in_turn(spark):
    """A task's rows are a few chunks, not a list for each row; a learner's weights are those of its own batches, one after another."""
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), None if i % 7 == 0 else float(rng.normal()), " ".join(rng.choice(["red", "Green", "blue"], rng.integers(0, 4)))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "y double, a double, text string").repartition(2)
    held = df.select("y", *[c.alias(f"c{i}") for i, c in enumerate(online._columns(["a"], ["text"], 9))])
    chunks = [online.Chunk.unpacked(r) for r in online._chunks(held, ["a"], ["text"], 9).collect()]
    assert len(chunks) == 2 and sum(len(c.y) for c in chunks) == 20_000
    value = lambda r: [(online.place("", 9), 1.0)] + ([(online.place("a", 9), r.c0)] if r.c0 is not None else []) + [(w, len(r.c1) ** -0.5) for w in r.c1]
    want = sorted((r.y, tuple((i, round(x, 12)) for i, x in value(r))) for r in held.collect())
    assert want == sorted((y, tuple((int(c.at[k]), round(x, 12)) for k, x in zip(c.key[a:b], c.x[a:b].tolist(), strict=True))) for c in chunks for y, a, b in zip(c.y.tolist(), c.edge[:-1], c.edge[1:], strict=True))
    c, size, tau, batch = chunks[0], 1 << 9, 0.7, 16
    w = rng.normal(size=size)
    for n, usual in ((1, None), (3, None), (3, rng.uniform(0.1, 1, size))):
        made = online.Learners(n, w, tau, 0.2, usual, batch)
        made.learn(c)
        own, moved, sums, t, seen = np.tile(w, (n, 1)), np.zeros((n, size)), np.zeros((n, size)), np.zeros(n), np.zeros(n)
        for k in range(0, len(c.y), batch):
            who, end, g = k // batch % n, min(k + batch, len(c.y)), np.zeros(size)
            for r in range(k, end):
                at, x = c.at[c.key[c.edge[r] : c.edge[r + 1]]], c.x[c.edge[r] : c.edge[r + 1]]
                e = c.y[r] - own[who][at] @ x
                np.add.at(g, at, (-tau if e > 0 else 1 - tau) * x / (end - k))
            sums[who] += g * g
            change = -0.2 * g / np.maximum(np.sqrt(sums[who]) if usual is None else usual * np.sqrt(1 + t[who]), 1e-12)
            own[who] += change
            moved[who] += t[who] * change
            t[who] += 1
            seen[who] += end - k
        mean = own - moved / t[:, None]
        assert np.allclose(made.result()[1:], np.concatenate([[len(c.y), t.sum()], seen @ mean, sums.sum(axis=0)]))


def test_maps_have_the_whole_grid_and_ends_of_all_six(spark):
    """140 x 140 points, and place and value of the largest and smallest of six maps (and the covariance); a crowded sky gives the same."""
    from tidemark.operators import spatial

    rng = random.Random(6)
    rows = [(s, rng.uniform(0, 4200), rng.uniform(0, 4200), rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(80) for s in (1, 2)]
    skies = spark.createDataFrame(rows, "sky_id long, x double, y double, e1 double, e2 double").repartition(3)
    at = (np.arange(140) + 0.5) * 30
    six = ["e1_mean", "e2_mean", "e1_var", "e2_var", "var_sum", "var_gap"]
    got = {r.sky_id: r for r in spatial.argmax_argmin(skies, six, 140).collect()}
    dealt = {r.sky_id: r for r in spatial.argmax_argmin(skies, six, 140, crowded=30).collect()}
    for sky in (1, 2):
        x, y, a, b = np.array([r[1:] for r in rows if r[0] == sky]).T
        w = np.exp(-((x[:, None, None] - at[:, None]) ** 2 + (y[:, None, None] - at) ** 2) / 2e6)
        mean = lambda v: (w * v[:, None, None]).sum(0) / w.sum(0)
        p, q = mean(a * a) - mean(a) ** 2, mean(b * b) - mean(b) ** 2
        for name, m in zip(six, (mean(a), mean(b), p, q, p + q, abs(p - q)), strict=True):
            for tag, k in (("max", m.argmax()), ("min", m.argmin())):
                for r in (got[sky], dealt[sky]):
                    assert r[f"{name}_{tag}"] == pytest.approx(m.flat[k], abs=2e-9) and (r[f"{name}_{tag}_i"], r[f"{name}_{tag}_j"]) == divmod(int(k), 140)
    sf = "/root/testdata/sf0.001"
    n = recast.view(spark, sf, "skies").select("sky_id").distinct().count()
    assert queries.QUERIES["grid_kernel_maps"](spark, sf).count() == n * 140 * 140
    ends = queries.QUERIES["argmax_argmin_maps"](spark, sf)
    assert ends.count() == n and all(f"{c}_{t}{p}" in ends.columns for c in six for t in ("max", "min") for p in ("", "_i", "_j"))

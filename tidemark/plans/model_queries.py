"""Registered queries of models, validation and image jobs.

Learners whose fit is a handful of sums (naive Bayes, ridge, a tree with a leaf for each cell) have a SQL twin to the last digit; the
others are tested against NumPy or on held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, dense, images, metrics, models, neighbours, online, prefix, prep, search, segments
from ..sources import io
from .learners_sql import bayes, cells, segment_trees
from .recast import as_sql, rounded, rounded_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_X = ["var8", "var10", "var13", "var15"]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def register(name: str, sql: str | None = None, columns: str = "", places: int = 9):
    names = columns.split()

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(lambda n: view(spark, sf_dir, n)), names, places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(as_sql(sql), names, places)
        return make

    return add


def _loss(v) -> DataFrame:
    rows = io.kept(v("loss"), "loss")  # the join runs once, not for each pass of a fit
    return prep.fill_from(rows, prep.fit_fill(rows, ["var15"])).withColumn("id", F.xxhash64(*_KEYS)).withColumn("y", (F.col("target") > 0).cast("double"))


def _passengers(v) -> DataFrame:
    rows = io.spread(v("passengers"), "passengers")
    rows = prep.fill_from(rows, prep.fit_fill(rows, ["fare", "age"], "median"))
    return prep.one_hot(rows, "sex", ["male"]).withColumn("survived", F.col("survived").cast("double"))


_PX = ["pclass", "fare", "age", "sex_male"]
_P = "(SELECT id, survived, CAST(pclass AS DOUBLE) AS pclass, sex, embarked, coalesce(fare, (SELECT median(fare) FROM {passengers})) AS fare, CAST(coalesce(age, (SELECT median(age) FROM {passengers})) AS DOUBLE) AS age, CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END AS sex_male FROM {passengers}) p"
_LOSS = "(SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target, CAST(var8 AS DOUBLE) AS var8, var10, var11, var13, coalesce(var15, (SELECT avg(var15) FROM {loss})) AS var15 FROM {loss}) x) l"
_Q = "(SELECT customer_id, shopping_pt, customer_id * 1000000 + shopping_pt AS key, a, b, cost, CAST(k AS DOUBLE) AS kk, risk_factor FROM {quotes}) q"


def _folds(n: int, features: list[str] = _PX) -> tuple[str, str]:
    """Training and test rows of each fold."""
    own, fold = ", ".join(features), f"(id * 2654435761) % 4294967296 % {n}"
    return f"SELECT f.k, survived AS y, {own} FROM {_P} CROSS JOIN (SELECT unnest(range({n})) AS k) f WHERE {fold} <> f.k", f"SELECT {fold} AS k, id AS key, {own} FROM {_P}"


def _whole(features: list[str] = _PX, train: str = "true", test: str = "true") -> tuple[str, str]:
    own = ", ".join(features)
    return f"SELECT 0 AS k, survived AS y, {own} FROM {_P} WHERE {train}", f"SELECT 0 AS k, id AS key, {own} FROM {_P} WHERE {test}"


def _answers(label: str, train: str = "true", test: str = "true") -> str:
    return bayes(f"SELECT 0 AS k, {label} AS y, cost, kk FROM {_Q} WHERE {train}", f"SELECT 0 AS k, key, cost, kk FROM {_Q} WHERE {test}", ["cost", "kk"])


# Linear models


@register(
    "model_ridge_weighted",
    "WITH m AS (SELECT sum(var11 * var10) / sum(var11) AS a, sum(var11 * var13) / sum(var11) AS b, sum(var11 * target) / sum(var11) AS t FROM {loss}), s AS (SELECT sum(var11 * (var10 - a) * (var10 - a)) + 20 AS aa, sum(var11 * (var10 - a) * (var13 - b)) AS ab, sum(var11 * (var13 - b) * (var13 - b)) + 20 AS bb, sum(var11 * (var10 - a) * (target - t)) AS ta, sum(var11 * (var13 - b) * (target - t)) AS tb FROM {loss}, m), c AS (SELECT (ta * bb - tb * ab) / (aa * bb - ab * ab) AS x, (tb * aa - ta * ab) / (aa * bb - ab * ab) AS y FROM s) SELECT 'var10' AS name, x AS weight FROM c UNION ALL SELECT 'var13', y FROM c UNION ALL SELECT 'one', t - a * x - b * y FROM c, m",
    "weight",
    4,
)
def model_ridge_weighted(v):
    rows = v("loss")
    return rows.sparkSession.createDataFrame(list(models.ridge_weights(rows, ["var10", "var13"], "target", 20.0, "var11").items()), "name string, weight double")


@register("model_linear_family")
def model_linear_family(v):
    """Ordinary, lasso and elastic net compared by five folds: error and normalised weighted Gini of rows that a model hasn't seen."""
    rows = prep.scale_standard(_loss(v), _X).withColumn("fold", F.pmod("id", F.lit(5)).cast("int"))
    return dense.linear_family(rows, _X, "target", "fold", 5, {"ordinary": (0.0, 0.0), "lasso": (10.0, 1.0), "elastic": (10.0, 0.5)}, "id", "var11")


@register("model_quantile_linear")
def model_quantile_linear(v):
    """The 0.8 quantile of every loss by numbers and the words of a text."""
    rows = prep.scale_standard(_loss(v), _X)
    return online.fit_quantile(rows, "target", _X, 0.8, words=["var4"], bits=12).predict(rows).select(*_KEYS, "target", "prediction")


register("model_group_then_regress", "WITH g AS (SELECT var4, regr_slope(target, var11) AS s, regr_intercept(target, var11) AS i FROM {loss} GROUP BY var4) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, g.i + g.s * var11 AS prediction FROM {loss} l JOIN g ON l.var4 = g.var4", "prediction", 4)(
    lambda v: models.group_then_regress(v("loss"), v("loss"), "var4", ["var11"], "target").select(*_KEYS, "prediction")
)

# Classifiers


def _classified(v, kind: str, **options) -> DataFrame:
    rows = _passengers(v)
    return models.pipeline(_PX, models.classifier(kind, "survived", **options)).fit(rows).transform(rows).select("id", "survived", "prediction")


for _kind, _options in (("logistic", {"maxIter": 20}), ("forest", {"numTrees": 10}), ("gbt", {"maxIter": 5}), ("mlp", {"layers": [4, 5, 2], "maxIter": 30})):
    _name = {"forest": "random_forest", "gbt": "gbt_classifier"}.get(_kind, _kind)
    register(f"model_{_name}")(lambda v, k=_kind, o=_options: _classified(v, k, **o))
register("baseline_first_forest")(lambda v: _classified(v, "forest", numTrees=20, maxDepth=6))
_WITH_LABEL = f"SELECT p.id, CAST(p.survived AS DOUBLE) AS survived, prediction FROM best JOIN {_P} ON best.key = p.id"
register("model_naive_bayes", bayes(*_whole(), _PX) + _WITH_LABEL)(lambda v: _classified(v, "bayes"))
_CELL = ["pclass", "sex_male"]


@register("model_decision_tree", cells(*_whole(_CELL), _CELL) + _WITH_LABEL)
def model_decision_tree(v):
    """Six cells of two columns: a tree this deep has a leaf for each."""
    rows = _passengers(v)
    return models.pipeline(_CELL, models.classifier("tree", "survived", maxDepth=5)).fit(rows).transform(rows).select("id", "survived", "prediction")


@register("model_svm")
def model_svm(v):
    """A linear machine on random Fourier columns of scaled fields, for an rbf kernel."""
    rows, names = models.fourier(prep.scale_standard(_passengers(v), _PX), _PX, 0.5, 40)
    return models.pipeline(names, models.classifier("svm", "survived", maxIter=20)).fit(rows).transform(rows).select("id", "survived", "prediction")



@register("model_gbt_regressor")
def model_gbt_regressor(v):
    """1000 trees of depth 3 on nine tenths of the rows each, for absolute and for squared loss, as the reference has them."""
    rows = _loss(v).select("id", "target", *_X)
    model = boosting.boost(rows, "id", _X, "target")
    return model.predict(model.predict(rows, "absolute"), "squared", "prediction_squared").select("id", "target", "prediction", "prediction_squared")


@register("model_importance")
def model_importance(v):
    rows = _loss(v)
    return models.importances(models.pipeline(_X, models.regressor("forest", "target", numTrees=10)).fit(rows).stages[-1], _X, rows.sparkSession)


@register("model_knn", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}), d AS (SELECT q.vec_id, t.vec_id AS o, t.label, list_distance(q.v, t.v) AS far FROM e q JOIN e t ON q.vec_id <> t.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, o) AS k FROM d) SELECT vec_id, CAST(label AS BIGINT) AS prediction FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS r FROM n WHERE k <= 5 GROUP BY vec_id, label) z WHERE r = 1")
def model_knn(v):
    """Every row by the five rows nearest to it among all others."""
    rows = v("embeddings").select("vec_id", F.col("label").cast("long").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return neighbours.knn(rows, rows, "vec_id", [f"f{i}" for i in range(64)], "label", 5, skip_own=True)


@register("model_majority", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT var4 FROM {loss} GROUP BY var4 ORDER BY count(*) DESC, var4 LIMIT 1) AS predicted FROM {loss}")
def model_majority(v):
    return v("loss").select(*_KEYS).crossJoin(F.broadcast(prefix.most_frequent(v("loss"), "var4").select(F.col("mode").alias("predicted"))))


# Composite models

_ON_LOSS = f"SELECT 0 AS k, CAST(target > 0 AS INT) AS y, {', '.join(_X)} FROM {_LOSS}", f"SELECT 0 AS k, key, {', '.join(_X)} FROM {_LOSS}"
_LINE = "(SELECT regr_slope(target, var11) AS s, regr_intercept(target, var11) AS i FROM {loss} WHERE target > 0) r"


@register("model_classify_then_regress", bayes(*_ON_LOSS, _X) + f"SELECT {', '.join(_KEYS)}, CASE WHEN prediction > 0 THEN i + s * var11 ELSE 0 END AS prediction FROM best JOIN {_LOSS} ON best.key = l.key CROSS JOIN {_LINE}", "prediction", 4)
def model_classify_then_regress(v):
    rows = _loss(v)
    model = models.TwoStage("target", _X, ["var11"], models.classifier("bayes", "y"), models.linear("target", "ordinary", 0).setSolver("normal"))
    return model.fit(rows).transform(rows).select(*_KEYS, "prediction")


_FAR = "(SELECT regr_slope(target - 9000, var11) AS s, regr_intercept(target - 9000, var11) AS i FROM {loss} WHERE target > 9000) r"


@register("model_bin_then_reg", cells(f"SELECT 0 AS k, CAST(target > 9000 AS INT) AS y, var8 FROM {_LOSS}", f"SELECT 0 AS k, key, var8 FROM {_LOSS}", ["var8"]) + f"SELECT {', '.join(_KEYS)}, CAST(CASE WHEN prediction > 0 THEN round(i + s * var11) ELSE 0 END AS DOUBLE) AS prediction FROM best JOIN {_LOSS} ON best.key = l.key CROSS JOIN {_FAR}", "prediction", 4)
def model_bin_then_reg(v):
    """Whether a loss is beyond 9000, by the cell of a field, then how far, in whole numbers."""
    rows = _loss(v).withColumn("target", F.col("target") - 9000)
    model = models.TwoStage("target", ["var8"], ["var11"], models.classifier("tree", "y", maxDepth=8), models.linear("target", "ordinary", 0).setSolver("normal"), whole=True)
    return model.fit(rows).transform(rows).select(*_KEYS, "prediction")


def _quotes(v) -> DataFrame:
    return v("quotes").withColumn("key", F.col("customer_id") * 1000000 + F.col("shopping_pt"))


@register("model_multi_output", f"SELECT x.key, concat(x.v, y.v) AS label FROM ({_answers('a')} SELECT key, CAST(prediction AS INT) AS v FROM best) x JOIN ({_answers('b')} SELECT key, CAST(prediction AS INT) AS v FROM best) y ON x.key = y.key")
def model_multi_output(v):
    rows = _quotes(v).withColumns({c: F.col(c).cast("double") for c in "ab"})
    return models.multi_output(rows, rows, ["a", "b"], ["cost", "k"], lambda c: models.classifier("bayes", c), "key")


_BINS = {"age": [20.0, 35.0, 50.0, 65.0], "fare": [15.0, 40.0, 60.0, 80.0]}
_BINNED = ", ".join(f"{' + '.join(f'CASE WHEN {f} >= {c} THEN 1 ELSE 0 END' for c in cuts)} AS {f}_bin" for f, cuts in _BINS.items())
_SEGMENTS = ["sex", "pclass", "embarked"]


@register("model_by_segment", segment_trees(f"SELECT id AS key, id % 2 AS fold, id % 4 <> 0 AS is_train, survived AS y, {', '.join(_SEGMENTS)}, {_BINNED} FROM {_P}", _SEGMENTS, ["age_bin", "fare_bin"], 2, 3, 2) + "SELECT key AS id, learner, prediction FROM best")
def model_by_segment(v):
    """By segment the more accurate of the most frequent class and a tree of two binned columns."""
    rows = _passengers(v)
    return segments.by_segment(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), _SEGMENTS, "survived", ["age", "fare"], "id", ("common", "tree"), depth=2, folds=2, cuts=_BINS)


@register("model_boost_mixed")
def model_boost_mixed(v):
    rows = _loss(v).select("id", "target", *_X)
    learners = {"linear": lambda c: models.linear(c, "ordinary", 0), "tree": lambda c: models.regressor("forest", c, numTrees=3, maxDepth=3)}
    return models.boost_predict(rows, models.boost_mixed(rows, "target", _X, learners, "id", rounds=3, share=0.8), "id").select("id", "target", "prediction")


@register("impute_model_based", f"{_answers('risk_factor', 'risk_factor IS NOT NULL', 'risk_factor IS NULL')} SELECT customer_id, shopping_pt, coalesce(CAST(risk_factor AS DOUBLE), prediction) AS risk_factor FROM {_Q} LEFT JOIN best ON q.key = best.key")
def impute_model_based(v):
    return models.impute_by_model(_quotes(v), "risk_factor", ["cost", "k"], models.classifier("bayes", "y"), "key").select("customer_id", "shopping_pt", "risk_factor")


# Components and selection


def _reduced(v, **how):
    rows = v("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return models.pca_reduce(rows, "vec_id", [f"f{i}" for i in range(64)], **how)


@register("pca_reduce")
def pca_reduce(v):
    """As many components as explain 85 % of the variance, each with a deviation of 1."""
    return _reduced(v, share=0.85, whiten=True)[0].select("vec_id", F.posexplode("components").alias("component", "value"))


@register("variance_cutoff")
def variance_cutoff(v):
    """The fewest components that explain more than half of the variance."""
    _, explained = _reduced(v, share=0.5)
    return v("embeddings").sparkSession.createDataFrame([(len(explained), float(sum(explained)))], "k long, explained double")


@register("svd_components")
def svd_components(v):
    """The first 20 right vectors of the centred matrix, as projections of every row."""
    return dense.svd(v("embeddings"), "vec_id", F.col("embedding"), 20)[0].select("vec_id", F.posexplode("components").alias("component", "value"))


@register("select_rfe")
def select_rfe(v):
    """Features by number, with the normalised Gini of predictions out of three folds."""
    rows = prep.scale_standard(_loss(v), _X)
    return dense.select_rfe(rows.withColumn("fold", F.pmod("id", F.lit(3)).cast("int")), _X, "target", "fold", 3, "id")


@register("select_top25_by_forest")
def select_top25_by_forest(v):
    """Scaled columns, a forest of 25 trees, the 25 strongest columns."""
    names = [f"f{i}" for i in range(64)]
    rows = v("embeddings").select(F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    model = models.pipeline(names, models.classifier("forest", "label", numTrees=25)).fit(prep.scale_standard(rows, names))
    return models.importances(model.stages[-1], names, rows.sparkSession).orderBy(F.desc("mean"), "name").limit(25)


# Validation and search


def _scored(v, n: int = 3) -> DataFrame:
    return search.out_of_fold(prep.cv_kfold(_passengers(v), "id", n), "fold", n, _PX, "survived", lambda: models.classifier("bayes", "survived"), "id", classes=2)


_ACC = f"SELECT best.k AS fold, avg(CAST(prediction = p.survived AS DOUBLE)) AS score FROM best JOIN {_P} ON best.key = p.id GROUP BY best.k"
#: Rows weigh 1 to 3; what is scored isn't what was learned.
_WEIGHT, _OTHER = "1 + id % 3", "CASE WHEN survived = 1 AND pclass < 3 THEN 1 ELSE 0 END"


@register("cross_val_score", bayes(*_folds(3, [*_PX, f"{_WEIGHT} AS weight"]), _PX, weight="weight") + f"SELECT best.k AS fold, sum(weight * CAST(prediction = other AS INT)) / CAST(sum(weight) AS DOUBLE) AS score, sum(weight * pow(pr.p - other, 2)) / sum(weight) AS brier FROM best JOIN pr ON best.key = pr.key AND pr.c = 1 JOIN (SELECT id, {_WEIGHT} AS weight, {_OTHER} AS other FROM {_P}) p ON best.key = p.id GROUP BY best.k", "score brier")
def cross_val_score(v):
    """Weighted in fit and score, another label for the score, and a score of probabilities; all folds in one pass."""
    rows = prep.cv_kfold(_passengers(v), "id", 3).withColumn("weight", F.expr(_WEIGHT)).withColumn("other", F.expr(_OTHER))
    held = search.bayes_out_of_fold(rows, "fold", 3, _PX, "survived", ["id", "other", "weight"], weight="weight")
    right, off = F.col("weight") * (F.col("prediction") == F.col("other")).cast("int"), F.col("weight") * F.pow(F.col("p")[1] - F.col("other"), 2)
    return held.groupBy(F.col("fold").cast("long").alias("fold")).agg((F.sum(right) / F.sum("weight")).alias("score"), (F.sum(off) / F.sum("weight")).alias("brier"))


register("out_of_fold_predict", bayes(*_folds(3), _PX) + f"SELECT p.id, best.k AS fold, CAST(p.survived AS DOUBLE) AS survived, prediction, p0.p AS p0, p1.p AS p1 FROM {_P} JOIN best ON best.key = p.id JOIN pr p0 ON p0.key = p.id AND p0.c = 0 JOIN pr p1 ON p1.key = p.id AND p1.c = 1", "p0 p1", 7)(
    lambda v: _scored(v).select("id", F.col("fold").cast("long"), "survived", "prediction", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))
)
#: How far a class must be ahead: the candidates of the searches.
_AHEAD = [(0.5, 0.5), (0.6, 0.4), (0.4, 0.6), (0.8, 0.2)]
#: parameters, score (mean over two folds) of every candidate.
_TRIED = " UNION ALL ".join(f"SELECT '{{''thresholds'': {t}}}' AS parameters, avg(score) AS score FROM ({bayes(*_folds(2), _PX, t)}{_ACC}) s{i}" for i, t in enumerate(_AHEAD))


def _table(v, found) -> DataFrame:
    return v("passengers").sparkSession.createDataFrame([(str(p), float(s)) for p, s in found], "parameters string, score double")


def _best(v, score: float) -> DataFrame:
    return v("passengers").sparkSession.createDataFrame([(float(score),)], "score double")


def _searched(v, folds: int = 2):
    rows = prep.cv_kfold(_passengers(v), "id", folds).persist()
    return rows, lambda p: models.classifier("bayes", "survived", **p), metrics.accuracy("survived", "prediction")


@register("grid_search", _TRIED, "score")
def grid_search(v):
    rows, make, score = _searched(v)
    found = _table(v, search.grid_search(rows, "fold", 2, _PX, "survived", make, {"thresholds": _AHEAD}, score, "id"))
    rows.unpersist()
    return found


#: Thresholds of the two classes: a grid of thirteen times thirteen.
_STEPS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]
_GRID = f"(SELECT unnest({_STEPS}) AS t0) g0 CROSS JOIN (SELECT unnest({_STEPS}) AS t1) g1"


@register("search_genetic", bayes(*_folds(2), _PX) + f"SELECT max(score) AS score FROM (SELECT t0, t1, avg(score) AS score FROM (SELECT w.k, t0, t1, avg(CAST(prediction = p.survived AS DOUBLE)) AS score FROM (SELECT k, key, t0, t1, arg_max(c, p / CASE c WHEN 0 THEN t0 ELSE t1 END) AS prediction FROM pr CROSS JOIN {_GRID} GROUP BY k, key, t0, t1) w JOIN {_P} ON w.key = p.id GROUP BY w.k, t0, t1) f GROUP BY t0, t1) t", "score")
def search_genetic(v):
    """The best of a grid of two parameters by scoring about half of it at most, four folds at a time. Candidates share the folds' models."""
    rows, _, _ = _searched(v)
    held = search.bayes_out_of_fold(rows, "fold", 2, _PX, "survived", ["survived"]).persist()
    p = F.col("p")

    def evaluate(c: dict, k: int) -> float:
        right = (p[1] / c["second"] > p[0] / c["first"]).cast("double") == F.col("survived")
        return held.where(F.col("fold") == k).agg(F.avg(right.cast("double")).alias("s")).first()["s"]

    trials = search.Trials(evaluate, 2, rows.sparkSession, at_once=4, most=1.0)
    _, value, _ = search.search_genetic(trials, {"first": _STEPS, "second": _STEPS}, population=16, elite=4, steps=6, mutation=0.5, first=[{"first": 0.5, "second": 0.5}])
    held.unpersist()
    rows.unpersist()
    return _best(v, value)


@register("fit_all_classifiers", f"SELECT 'bayes' AS parameters, avg(score) AS score FROM ({bayes(*_folds(3, _CELL), _CELL)}{_ACC}) a UNION ALL SELECT 'tree', avg(score) FROM ({cells(*_folds(3, _CELL), _CELL)}{_ACC}) b", "score")
def fit_all_classifiers(v):
    rows, _, score = _searched(v, 3)
    found = _table(v, search.best_of(rows, "fold", 3, _CELL, "survived", {"tree": lambda: models.classifier("tree", "survived", maxDepth=5), "bayes": lambda: models.classifier("bayes", "survived")}, score, "id"))
    rows.unpersist()
    return found


@register("fit_with_search", f"SELECT max(score) AS score FROM ({_TRIED}) t", "score")
def fit_with_search(v):
    """Grid search, then the best is fitted on all rows and stored with its score if that beats the stored one."""
    rows, make, score = _searched(v)
    found = search.grid_search(rows, "fold", 2, _PX, "survived", make, {"thresholds": _AHEAD}, score, "id")
    path = io.fresh(rows.sparkSession, "model")
    stored = io.save_if_better(models.pipeline(_PX, make(found[0][0])).fit(rows), found[0][1], path, rows.sparkSession)
    rows.unpersist()
    return _best(v, stored)


@register("make_pipeline", f"SELECT avg(score) AS score, CAST(2 AS BIGINT) AS candidates FROM ({bayes(*_folds(2), _PX, [0.6, 0.4])}{_ACC}) s", "score")
def make_pipeline(v):
    """Named steps with a grid of parameters by step: assembled fields, then a classifier; the second candidate's score."""
    rows, _, score = _searched(v)
    made, candidates = models.make_pipeline({"fields": models.assembled(_PX), "model": models.classifier("bayes", "survived")}, {"model__thresholds": _AHEAD[:2]})
    scored = search.out_of_fold(rows, "fold", 2, _PX, "survived", lambda: models.configured(made, candidates[1]), "id")
    value = search.cross_val_score(scored, "fold", score).agg(F.avg("score")).first()[0]
    rows.unpersist()
    return _best(v, value).withColumn("candidates", F.lit(len(candidates)).cast("long"))


def _report(c: int) -> str:
    hit = f"count(*) FILTER (y = {c} AND q = {c})"
    return f"SELECT {c} AS class, {hit} / nullif(CAST(count(*) FILTER (q = {c}) AS DOUBLE), 0) AS precision, {hit} / CAST(count(*) FILTER (y = {c}) AS DOUBLE) AS recall, 2 * {hit} / CAST(count(*) FILTER (y = {c}) + count(*) FILTER (q = {c}) AS DOUBLE) AS f1, count(*) FILTER (y = {c}) AS support FROM z"


def _tested(v) -> DataFrame:
    rows = _passengers(v)
    return models.pipeline(_PX, models.classifier("bayes", "survived")).fit(rows.where("id % 4 <> 0")).transform(rows.where("id % 4 = 0"))


_TESTED = bayes(*_whole(train="id % 4 <> 0", test="id % 4 = 0"), _PX)
register("train_and_report", _TESTED + f", z AS (SELECT p.survived AS y, prediction AS q FROM best JOIN {_P} ON best.key = p.id) {_report(0)} UNION ALL {_report(1)}", "precision recall f1")(lambda v: metrics.classification_report(_tested(v), "survived", "prediction"))


@register("predict_and_submit", _TESTED + "SELECT key AS id, CAST(prediction AS BIGINT) AS prediction FROM best")
def predict_and_submit(v):
    """Fitted on the labelled rows, predicted for the others, every id with a whole prediction."""
    return io.submission(_passengers(v).where("id % 4 = 0"), _tested(v).select("id", "prediction"), "id", "prediction", whole=True)


# Tables and sinks

register("split_shuffle", "SELECT id, (id * 2654435761 + 11) % 4294967296 < 0.3 * 4294967296 AS is_test FROM {passengers}")(lambda v: v("passengers").select("id", (prep.shuffled("id", 11) < 0.3 * 4294967296).alias("is_test")))
register("load_titanic_table", f"SELECT id, CAST(survived AS DOUBLE) AS survived, CAST(pclass AS INT) AS pclass, fare, age, CAST(sex_male AS INT) AS sex_male, dense_rank() OVER (ORDER BY embarked) - 1 AS embarked_code, 1.0::DOUBLE AS weight FROM {_P}", "fare age")(
    lambda v: _passengers(v).join(prefix.integerize([v("passengers")], "embarked").withColumnRenamed("code", "embarked_code"), "embarked", "left").select("id", "survived", *_PX, "embarked_code", F.lit(1.0).alias("weight"))
)


@register("sink_model_best", "SELECT pclass, max(score) OVER (ORDER BY pclass) AS stored FROM (SELECT pclass, avg(survived) AS score FROM {passengers} GROUP BY pclass) t", "stored")
def sink_model_best(v):
    """Models with a score for each class of passengers, in turn: a stored one is replaced only by a better one."""
    rows = _passengers(v)
    model = models.pipeline(_PX, models.classifier("tree", "survived", maxDepth=2)).fit(rows)
    path = io.fresh(rows.sparkSession, "model")
    scores = rows.groupBy("pclass").agg(F.avg("survived").alias("score")).orderBy("pclass").collect()  # a row for each class
    kept = [(r["pclass"], io.save_if_better(model, r["score"], path, rows.sparkSession)) for r in scores]
    return rows.sparkSession.createDataFrame(kept, "pclass long, stored double")


# Images

_DARK = """WITH RECURSIVE px AS (SELECT image_id, r, c, r * 8 + c AS i, v < 255 AS shown, v < avg(v) OVER (PARTITION BY image_id) AS dark FROM {pixels}),
d AS (SELECT DISTINCT a.image_id, a.r, a.c, a.i, a.dark FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.dark),
g(image_id, i, o) AS (SELECT image_id, i, i FROM d UNION SELECT g.image_id, g.i, y.i FROM g JOIN d x ON g.image_id = x.image_id AND g.o = x.i JOIN d y ON y.image_id = x.image_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
m AS (SELECT image_id, i, max(o) AS region FROM g GROUP BY image_id, i),
l AS (SELECT d.image_id, region, d.r, d.c FROM d JOIN m ON d.image_id = m.image_id AND d.i = m.i WHERE dark),
b AS (SELECT k.image_id, k.region, n.r, n.c FROM (SELECT DISTINCT image_id, region FROM l) k CROSS JOIN (SELECT rr AS r, cc AS c FROM (SELECT unnest(range(-1, 9)) AS rr) x CROSS JOIN (SELECT unnest(range(-1, 9)) AS cc) y) n LEFT JOIN l ON l.image_id = k.image_id AND l.region = k.region AND l.r = n.r AND l.c = n.c WHERE l.r IS NULL),
f(image_id, region, r, c) AS (SELECT * FROM b WHERE r IN (-1, 8) OR c IN (-1, 8) UNION SELECT b.* FROM f JOIN b ON f.image_id = b.image_id AND f.region = b.region AND abs(f.r - b.r) <= 1 AND abs(f.c - b.c) <= 1),
h AS (SELECT image_id, region, 64 - count(*) FILTER (r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7) AS filled FROM f GROUP BY image_id, region),
s AS (SELECT l.image_id, l.region, count(*) AS size, max(filled) AS filled, covar_pop(c, r) AS xy, var_pop(c) AS xx, var_pop(r) AS yy FROM l JOIN h ON l.image_id = h.image_id AND l.region = h.region GROUP BY l.image_id, l.region),
e AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS big, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS low, row_number() OVER (PARTITION BY image_id ORDER BY filled DESC, region) AS k FROM s),
a AS (SELECT image_id, count(*) AS n_regions, max(filled) AS largest, avg(filled) AS mean_size, max(filled) / CAST(min(filled) AS DOUBLE) AS to_smallest, max(filled) / avg(filled) AS to_mean FROM e GROUP BY image_id)
SELECT i.image_id, coalesce(n_regions, 0) AS n_regions, coalesce(largest, -1) AS largest, coalesce(size, -1) AS dark, coalesce(mean_size, -1) AS mean_size, coalesce(largest / CAST(area AS DOUBLE), -1) AS largest_share, coalesce(to_smallest, -1) AS to_smallest, coalesce(to_mean, -1) AS to_mean,
  CASE WHEN n_regions IS NULL OR big <= 0 THEN -1 ELSE sqrt(greatest(low, 0) / big) END AS axis_ratio
FROM (SELECT image_id, count(*) FILTER (shown) AS area FROM px GROUP BY image_id) i LEFT JOIN a ON i.image_id = a.image_id LEFT JOIN e ON e.image_id = i.image_id AND e.k = 1"""
_TURN = """WITH o AS (SELECT image_id, angle, y * 6 + x AS p, (y + 0.5) * 8 / 6 - 0.5 - 3.5 AS dy, (x + 0.5) * 8 / 6 - 0.5 - 3.5 AS dx, radians(angle) AS a FROM (SELECT DISTINCT image_id FROM {pixels}) i CROSS JOIN (SELECT unnest([0, 90, 180, 270]) AS angle) g CROSS JOIN (SELECT unnest(range(6)) AS y) yy CROSS JOIN (SELECT unnest(range(6)) AS x) xx),
s AS (SELECT image_id, angle, p, least(greatest(3.5 + dy * cos(a) - dx * sin(a), -2), 8.999) AS sy, least(greatest(3.5 + dy * sin(a) + dx * cos(a), -2), 8.999) AS sx FROM o),
f AS (SELECT *, CAST(floor(sy) AS INT) AS i, CAST(floor(sx) AS INT) AS j, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM s),
q AS (SELECT image_id, angle, p, i + di AS r, j + dj AS c, CASE di WHEN 0 THEN 1 - fy ELSE fy END * CASE dj WHEN 0 THEN 1 - fx ELSE fx END AS w FROM f CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS di, unnest([0, 1, 0, 1]) AS dj) n)
SELECT q.image_id, CAST(angle AS DOUBLE) AS angle, CAST(p AS INT) AS p, 255 - sum(w * coalesce(v, 255)) AS v FROM q LEFT JOIN {pixels} x ON q.image_id = x.image_id AND q.r = x.r AND q.c = x.c GROUP BY q.image_id, angle, p"""
register("image_region_stats", _DARK, "mean_size largest_share to_smallest to_mean axis_ratio", 6)(lambda v: images.region_stats(images.as_arrays(v("pixels"))))
register("image_resize_rotate", _TURN, "v", 6)(lambda v: images.augment(images.as_arrays(v("pixels")), 6, 6).select("image_id", "angle", F.posexplode("flat").alias("p", "v")))

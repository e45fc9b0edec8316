"""Models on Spark ML, and the composite ones: two-stage, grouped, by segment, several outputs, boosting with mixed learners.

Training data stay distributed; what comes to the driver is coefficients, scores and small tables whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from . import online
from .prefix import integerize, percentiles
from .relational import small


def assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error")


def pipeline(features: Sequence[str], learner) -> Pipeline:
    return Pipeline(stages=[assembled(features), learner])


def make_pipeline(steps: Mapping[str, object], parameters: Mapping[str, Sequence] | None = None) -> tuple[Pipeline, list[dict]]:
    """A pipeline of named steps, and every combination of a grid whose keys are `step__parameter`, as maps for configured()."""
    names = list(steps)
    found: list[dict] = [{}]
    for key, values in (parameters or {}).items():
        step, parameter = key.split("__", 1)
        if step not in steps or not steps[step].hasParam(parameter):
            raise ValueError(f"no parameter {key}")
        found = [{**f, (names.index(step), parameter): v} for f in found for v in values]
    return Pipeline(stages=list(steps.values())), found


def configured(made: Pipeline, parameters: Mapping[tuple[int, str], object]) -> Pipeline:
    """A copy of the pipeline with these parameters of its steps."""
    stages = [s.copy() for s in made.getStages()]
    for (i, name), value in parameters.items():
        stages[i].set(stages[i].getParam(name), value)
    return Pipeline(stages=stages)


def ridge_weights(df: DataFrame, features: Sequence[str], label: str, alpha: float, weight: str | None = None) -> dict[str, float]:
    """Weights by name ("one": the constant, not penalised) of a weighted ridge with penalty alpha on the sum of squares, from one
    aggregate of products, taken about the means so that large offsets cost no digits."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = [*features, label]
    means = df.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in held]).first()
    x = [F.col(c) - F.lit(float(means[c])) for c in held]
    sums = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"{i}_{j}") for i in range(len(held)) for j in range(i + 1)]).first()
    m = np.array([[sums[f"{max(i, j)}_{min(i, j)}"] for j in range(len(held))] for i in range(len(held))], dtype=float)
    k = len(features)
    found = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
    return {"one": float(means[label] - sum(v * means[c] for v, c in zip(found, features, strict=True))), **{c: float(v) for c, v in zip(features, found, strict=True)}}


def linear(label: str, kind: str, alpha: float) -> LinearRegression:
    """kind: ordinary, lasso or elastic."""
    share = {"ordinary": 0.0, "lasso": 1.0, "elastic": 0.5}[kind]
    return LinearRegression(featuresCol="__features", labelCol=label, elasticNetParam=share, regParam=0.0 if kind == "ordinary" else alpha)


def classifier(kind: str, label: str, seed: int = 7, **options):
    """logistic, forest, tree, gbt, svm, bayes or mlp (layers is needed)."""
    own = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "tree": DecisionTreeClassifier, "gbt": GBTClassifier, "svm": LinearSVC, "bayes": NaiveBayes, "mlp": MultilayerPerceptronClassifier}[kind]
    if kind == "bayes":
        options.setdefault("modelType", "gaussian")
    made = own(featuresCol="__features", labelCol=label, **options)
    return made.setSeed(seed) if made.hasParam("seed") else made


def regressor(kind: str, label: str, seed: int = 7, **options):
    """forest or gbt (lossType squared or absolute)."""
    return {"forest": RandomForestRegressor, "gbt": GBTRegressor}[kind](featuresCol="__features", labelCol=label, seed=seed, **options)


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """name, mean, sd over the trees of a fitted forest."""
    trees = np.array([t.featureImportances.toArray() for t in getattr(model, "trees", [model])])
    return spark.createDataFrame([(f, float(trees[:, i].mean()), float(trees[:, i].std())) for i, f in enumerate(features)], "name string, mean double, sd double")


def fourier(df: DataFrame, features: Sequence[str], gamma: float, n: int, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """Random Fourier columns that stand for an rbf kernel, approximately."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (n, len(features))), rng.uniform(0, 2 * np.pi, n)
    names = [f"__rff{i}" for i in range(n)]
    return df.withColumns({c: F.sqrt(F.lit(2.0 / n)) * F.cos(sum((F.col(f) * float(w[i, k]) for k, f in enumerate(features)), F.lit(float(b[i])))) for i, c in enumerate(names)}), names


@dataclass
class TwoStage:
    """A classifier of y > 0 on one field set, a regressor of the positive rows on another; 0 where the class is 0."""

    label: str
    class_features: Sequence[str]
    reg_features: Sequence[str]
    classifier: object
    regressor: object
    whole: bool = False
    fitted: tuple = field(default=(), init=False)

    def fit(self, df: DataFrame) -> TwoStage:
        held = df.withColumn("__class", (F.col(self.label) > 0).cast("double"))
        self.fitted = (pipeline(self.class_features, self.classifier.setLabelCol("__class").setPredictionCol("__p")).fit(held), pipeline(self.reg_features, self.regressor.setLabelCol(self.label).setPredictionCol("__r")).fit(held.where("__class = 1")))
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """whole: predictions in (0, 1) become 1, and all are rounded."""
        keep = df.columns
        a = self.fitted[0].transform(df).select(*keep, "__p")
        r = F.col("__r")
        if self.whole:
            r = F.round(F.when((r > 0) & (r < 1), 1.0).otherwise(r))
        return self.fitted[1].transform(a).select(*keep, F.when(F.col("__p") > 0, r).otherwise(0.0).alias(out))


def group_then_regress(train: DataFrame, test: DataFrame, group: str, features: Sequence[str], label: str, alpha: float = 0.0, weight: str | None = None, out: str = "prediction") -> DataFrame:
    """One weighted ridge for each group, and one over all for groups that train lacks. A group is one row of sums of products
    (as many as the features squared), so its rows are never brought together."""
    x = ["__one", *features]
    w = F.col(weight) if weight else F.lit(1.0)
    held = train.withColumn("__one", F.lit(1.0))
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j <= i] + [F.sum(w * F.col(a) * F.col(label)).alias(f"y_{i}") for i, a in enumerate(x)]
    by = held.groupBy(group).agg(*sums).withColumn("__all", F.lit(False))
    whole = held.agg(*sums).withColumn(group, F.lit(None).cast(train.schema[group].dataType)).withColumn("__all", F.lit(True))
    k = len(x)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = dict(zip(pdf.columns, r, strict=True))
                a = np.array([[d[f"{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                penalty = alpha * np.eye(k)
                penalty[0, 0] = 0
                rows.append([float(v) for v in np.linalg.lstsq(a + penalty, np.array([d[f"y_{i}"] for i in range(k)], dtype=float), rcond=None)[0]])
            yield pd.DataFrame({group: pdf[group], "__all": pdf["__all"], "__w": rows})

    kind = train.schema[group].dataType.simpleString()
    weights = by.unionByName(whole).mapInPandas(solve, f"{group} {kind}, __all boolean, __w array<double>")
    own = test.join(weights.where("not __all").select(group, F.col("__w").alias("__g")), group, "left").crossJoin(F.broadcast(weights.where("__all").select(F.col("__w").alias("__a"))))
    c = F.coalesce("__g", "__a")
    return own.withColumn(out, sum((c[i + 1] * F.col(f) for i, f in enumerate(features)), c[0])).drop("__g", "__a")


def multi_output(train: DataFrame, test: DataFrame, labels: Sequence[str], features: Sequence[str], learner: Callable[[str], object], key: str) -> DataFrame:
    """key, and the answers of one classifier for each label joined to one string."""
    held = test.select(key, *features)
    for c in labels:
        model = pipeline(features, learner(c).setPredictionCol(f"__{c}")).fit(train)
        held = model.transform(held).select(*held.columns, f"__{c}")
    return held.select(key, F.concat_ws("", *[F.col(f"__{c}").cast("int").cast("string") for c in labels]).alias("label"))


@dataclass(frozen=True)
class Loss:
    """What boosting needs of a loss: its value (convex in the prediction) and negative gradient as expressions of label and prediction, and
    the best constant of a table's label."""

    value: Callable[[Column, Column], Column]
    gradient: Callable[[Column, Column], Column]
    start: Callable[[DataFrame, str], float]


SQUARED = Loss(lambda y, p: (y - p) ** 2, lambda y, p: y - p, lambda df, y: float(df.agg(F.avg(y)).first()[0]))
ABSOLUTE = Loss(lambda y, p: F.abs(y - p), lambda y, p: F.signum(y - p), lambda df, y: float(percentiles(df, y, [0.5]).first()["p"][0]))
#: Steps of a line that are tried at first, each a share of the least squares step; then as many between the neighbours of the best, so many times.
TRIED, FINER = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0], 3


def best_step(shown: DataFrame, loss: Loss) -> tuple[float, float]:
    """(step, mean loss) with the step along __h that lowers the loss of __y against __p most: closed form for squares, else a line search
    whose steps are tried nine at a time in one aggregate."""
    y, p, h = F.col("__y"), F.col("__p"), F.col("__h")
    sums = shown.agg(F.sum((y - p) * h).alias("top"), F.sum(h * h).alias("bottom"), F.avg((y - p) ** 2).alias("error"), F.count("*").alias("n")).first()
    step = sums["top"] / sums["bottom"] if sums["bottom"] else 0.0
    if loss is SQUARED:
        return step, (sums["error"] or 0.0) - step * (sums["top"] or 0.0) / max(sums["n"], 1)
    at = [t * step for t in TRIED]
    for k in range(1 + FINER):
        got = [x if x is not None else 0.0 for x in shown.agg(*[F.avg(loss.value(y, p + t * h)) for t in at]).first()]
        i = min(range(len(at)), key=lambda j: got[j])
        if k == FINER or not step:
            return at[i], got[i]
        low, high = at[max(i - 1, 0)], at[min(i + 1, len(at) - 1)]
        at = [low + (high - low) * j / (len(TRIED) - 1) for j in range(len(TRIED))]
    raise AssertionError


def boost_mixed(train: DataFrame, label: str, features: Sequence[str], learners: Mapping[str, Callable[[str], object]], key: str, rounds: int = 5, shrinkage: float = 0.5, enough: float = 1e-6, patience: int = 2, folds: int = 2, loss: Loss = SQUARED, share: float = 1.0, seed: int = 7) -> tuple[float, list]:
    """(constant, [(weight, fitted pipeline)]): stages each fit the loss's negative gradient with the learner whose out-of-fold predictions
    lower the loss most, with their best step, on a share of the rows drawn anew for each stage; the weight is the best step times the
    shrinkage. It ends at an error of `enough`, or after `patience` stages without a better one. Predictions are written out by stage, so
    lineage stays short."""
    y, p = F.col("__y"), F.col("__p")
    own = train.select(key, *features, F.col(label).cast("double").alias("__y"))
    constant = loss.start(own, "__y")
    held = own.select("*", F.lit(constant).alias("__p"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("__fold"))
    stages, best, stuck = [], float("inf"), 0
    for k in range(rounds):
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(1_000_000)) < share * 1_000_000
        held = kept(held.withColumn("__g", loss.gradient(y, p)), "boosting")
        rows = held.where(drawn) if share < 1 else held
        losses = {}
        for name, make in learners.items():
            parts = [pipeline(features, make("__g").setPredictionCol("__h")).fit(rows.where(F.col("__fold") != f)).transform(rows.where(F.col("__fold") == f)).select("__y", "__p", "__h") for f in range(folds)]
            out = reduce(DataFrame.unionByName, parts).persist()
            losses[name] = best_step(out, loss)[1]
            out.unpersist()
        chosen = min(losses, key=lambda n: (losses[n], n))
        model = pipeline(features, learners[chosen]("__g").setPredictionCol("__h")).fit(rows)
        shown = model.transform(held).select(*held.columns, "__h").persist()
        step = best_step(shown, loss)[0] * shrinkage
        held = kept(shown.select(key, *features, "__y", (p + step * F.col("__h")).alias("__p"), "__fold"), "boosting")
        shown.unpersist()
        error = held.agg(F.avg(loss.value(y, p))).first()[0]
        stages.append((step, model))
        stuck = stuck + 1 if error >= best * (1 - 1e-9) else 0
        best = min(best, error)
        if error <= enough or stuck >= patience:
            break
    return constant, stages


def boost_predict(df: DataFrame, boosted: tuple[float, list], key: str, out: str = "prediction") -> DataFrame:
    constant, stages = boosted
    held, columns = df.withColumn(out, F.lit(constant)), df.columns
    for step, model in stages:
        held = model.transform(held).select(*columns, (F.col(out) + step * F.col("__h")).alias(out))
    return held


def quantile_linear(df: DataFrame, label: str, features: Sequence[str], tau: float, **how) -> list[float]:
    """Weights (constant first) of a linear model with pinball loss of named columns, which should be scaled; for texts and other options
    see online.fit_quantile()."""
    bits = next(b for b in range(8, 60) if len({online.place(f, b) for f in ("", *features)}) == len(features) + 1)  # each has a place of its own
    found = online.fit_quantile(df, label, features, tau, bits=bits, **how)
    return [found.weight(), *[found.weight(f) for f in features]]


def pca_reduce(df: DataFrame, key: str, features: Sequence[str], count: int | None = None, share: float | None = None, whiten: bool = False) -> tuple[DataFrame, list[float]]:
    """(key, components as an array; explained shares): by number, or the fewest that explain the share. Columns are centred first,
    each component's largest loading is positive, whitening divides by the component's deviation."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    held = assembled(features).transform(df.select(key, *[(F.col(c) - float(means[c])).alias(c) for c in features]))
    model = PCA(k=count or len(features), inputCol="__features", outputCol="__pca").fit(held)
    explained = model.explainedVariance.toArray()
    k = count or int(np.searchsorted(np.cumsum(explained), share) + 1)
    loads = model.pc.toArray()[:, :k]
    sign = np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(k)])
    sd = [1.0] * k
    out = model.transform(held).select(key, vector_to_array("__pca").alias("p"))
    if whiten:
        one = out.agg(*[F.stddev_samp(F.col("p")[i]).alias(str(i)) for i in range(k)]).first()
        sd = [float(one[i]) or 1.0 for i in range(k)]
    return out.select(key, F.array(*[F.col("p")[i] * float(sign[i] / sd[i]) for i in range(k)]).alias("components")), [float(x) for x in explained[:k]]


def impute_by_model(df: DataFrame, column: str, features: Sequence[str], learner, key: str) -> DataFrame:
    """Missing values of a whole-number column are predicted by a classifier fitted on the rows that have it. Its classes are the places
    of the values among those that occur."""
    present = df.where(F.col(column).isNotNull()).withColumn("__v", F.round(column).cast("double"))
    codes = small(integerize([present], "__v").select("__v", F.col("code").cast("double").alias("__y")))
    model = pipeline(features, learner.setLabelCol("__y").setPredictionCol("__p")).fit(present.join(codes, "__v"))
    filled = model.transform(df.where(F.col(column).isNull()).select(key, *features)).select(key, F.col("__p").alias("__y")).join(codes, "__y").select(key, F.col("__v").alias("__fill"))
    return df.join(filled, key, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), "__fill")).drop("__fill")


def first_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("__k = 1").drop("__k")

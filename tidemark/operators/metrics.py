"""Scores of predictions and correlations, each an aggregate over a scored table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy")


def precision(y: str, p: str) -> Column:
    return F.try_divide(F.count_if((F.col(y) == 1) & (F.col(p) == 1)), F.count_if(F.col(p) == 1)).alias("precision")


def recall(y: str, p: str) -> Column:
    return F.try_divide(F.count_if((F.col(y) == 1) & (F.col(p) == 1)), F.count_if(F.col(y) == 1)).alias("recall")


def f1(y: str, p: str) -> Column:
    hit = F.count_if((F.col(y) == 1) & (F.col(p) == 1))
    return F.try_divide(2 * hit, F.count_if(F.col(y) == 1) + F.count_if(F.col(p) == 1)).alias("f1")


def hinge(y: str, s: Column) -> Column:
    """y: 0 or 1."""
    return F.avg(F.greatest(F.lit(0.0), 1 - (2 * F.col(y) - 1) * s)).alias("hinge")


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p)).alias("mae")


def r_squared(y: str, p: str) -> Column:
    return (F.corr(y, p) * F.corr(y, p)).alias("r_squared")


def zero_one_by_class(df: DataFrame, split: str, y: str, p: str) -> DataFrame:
    """accuracy, accuracy on zeros and on ones: by split, then averaged."""
    right = (F.col(y) == F.col(p)).cast("double")
    by = df.groupBy(split).agg(F.avg(right).alias("a"), F.avg(F.when(F.col(y) == 0, right)).alias("z"), F.avg(F.when(F.col(y) == 1, right)).alias("o"))
    return by.agg(F.avg("a").alias("accuracy"), F.avg("z").alias("on_zeros"), F.avg("o").alias("on_ones"))


def multiclass_logloss(y: str, probabilities: str, eps: float = 1e-15) -> Column:
    """Clip, renormalise, then the mean of -log p of the true class (from 0)."""
    p = F.transform(probabilities, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.avg(-F.log(F.get(p, F.col(y).cast("int")) / total)).alias("logloss")


def nll(y: str, probabilities: str) -> Column:
    return F.avg(-F.log(F.get(F.col(probabilities), F.col(y).cast("int")))).alias("nll")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0).cast("double"), lambda a, b: a + b))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class: precision, recall, f1, support; from the confusion matrix, whose size is that of the classes."""
    m = confusion_matrix(df, y, p)
    rows = m.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = m.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    out = rows.join(said, "class", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return out.select("class", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


#: Terms of the continued fraction: with 100, p is within 1e-11 of its limit from 3 to a million rows.
TERMS = 100


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): twenty steps up, then the asymptotic series."""
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(1.0), lambda s, i: s * (a + i) / (a + i + 0.5))
    z = a + 20
    return steps * F.exp(0.5 * F.log(z) - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7)) - 31 / (18432 * F.pow(z, 9)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = F.lit(1e-300)
    away = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)
    d0 = 1 / away(1 - (a + b) * x / (a + 1))

    def half(s: Column, k: Column) -> Column:
        d, c = 1 / away(1 + k * s["d"]), away(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def term(s: Column, i: Column) -> Column:
        """i: 2 and 3 are the two halves of the first term."""
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(i % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * TERMS + 1)), F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h")), term, lambda s: s["h"])


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n rows: the regularised incomplete beta function I(1 - r^2; (n - 2) / 2, 1 / 2). Null with fewer
    than three rows or without r; 0 where r is 1 or -1."""
    held = F.struct((r * r).cast("double").alias("y"), ((n - 2) / 2.0).alias("a"))

    def of(s: Column) -> Column:
        y, a, half = s["y"], s["a"], F.lit(0.5)
        front = F.exp(a * F.log1p(-y) + 0.5 * F.log(y)) * _gamma_ratio(a) / np.sqrt(np.pi)
        low = 1 - y < (a + 1) / (a + 2.5)
        left = F.when(low, a).otherwise(half)  # one fraction, of the side on which it converges
        part = front * _beta_fraction(left, F.when(low, half).otherwise(a), F.when(low, 1 - y).otherwise(y)) / left
        p = F.least(F.greatest(F.when(low, part).otherwise(1 - part), F.lit(0.0)), F.lit(1.0))
        return F.when(y.isNull() | a.isNull(), None).when((a > 0) & (y >= 1), 0.0).when((a > 0) & (y == 0), 1.0).when(a > 0, p)

    return F.transform(F.array(held), of)[0]  # r and n are worked out once


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """column_name, abs_r, n, t (of the t statistic), p for each column, in one pass; rows with both values count."""
    both = lambda c: F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1))
    one = df.agg(*[x for i, c in enumerate(columns) for x in (F.corr(c, target).alias(f"r{i}"), both(c).alias(f"n{i}"))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])))
    return rows.withColumn("p", p_value(F.col("r"), F.col("n"))).select("column_name", F.abs("r").alias("abs_r"), "n", (F.abs("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))).alias("t"), "p")


def top_corr(df: DataFrame, columns: Sequence[str], target: str, k: int) -> DataFrame:
    return corr_with_target(df, columns, target).select("column_name", "abs_r").orderBy(F.desc("abs_r"), "column_name").limit(k)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r, n, p for all pairs of columns, from one pass over the rows with all of them; the matrix is as large as the columns squared."""
    spark = df.sparkSession
    rows = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="skip").transform(df)
    m = Correlation.corr(rows, "__v").first()[0].toArray()
    n = df.agg(F.count_if(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])).alias("n")).first()["n"]
    found = spark.createDataFrame([(a, b, float(m[i, j]), n) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], "a string, b string, r double, n long")
    return found.withColumn("p", p_value(F.col("r"), F.col("n")))


def attribute_distance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return corr_matrix(df, columns).select("a", "b", (1 - F.abs("r")).alias("distance"))


def attribute_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__sd"), F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{k}").alias(k) for k in ("n", "mean", "sd", "min", "max")]) for c in columns])))


def cv_summary(scores: DataFrame, fold: str, y: str, p: str) -> DataFrame:
    """mean, sd and sd / mean over folds of the mean absolute error."""
    by = scores.groupBy(fold).agg(mae(F.col(y), F.col(p)))
    return by.agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("sd")).withColumn("ratio", F.try_divide("sd", "mean"))


def halo_match(skies: DataFrame) -> DataFrame:
    """skies: sky_id, true and predicted points (arrays of x, y of equal length up to 3), x_ref, y_ref. score: mean distance under
    the permutation with the least total distance / 1000, plus the length of the mean direction about the reference point."""
    orders = {1: [(0,)], 2: [(0, 1), (1, 0)], 3: [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]}
    far = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    best = None
    for n, perms in orders.items():
        each = F.array(*[F.struct(sum((far(F.get("truth", F.lit(i)), F.get("guess", F.lit(j))) for i, j in enumerate(p)), F.lit(0.0)).alias("d"), F.array(*map(F.lit, p)).alias("order")) for p in perms])
        best = F.when(F.size("truth") == n, F.array_min(each)) if best is None else best.when(F.size("truth") == n, F.array_min(each))
    held = skies.withColumn("best", best)
    rows = held.select("sky_id", "x_ref", "y_ref", F.posexplode("truth").alias("i", "t"), "guess", "best").withColumn("g", F.get("guess", F.get("best.order", F.col("i"))))
    rows = rows.withColumn("far", far(F.col("t"), F.col("g")))
    phi = F.atan2(F.col("g.y") - F.col("t.y"), F.col("g.x") - F.col("t.x")) - F.atan2(F.col("y_ref") - F.col("t.y"), F.col("x_ref") - F.col("t.x"))
    return rows.agg(F.avg("far").alias("mean_distance"), F.sqrt(F.pow(F.avg(F.cos(phi)), 2) + F.pow(F.avg(F.sin(phi)), 2)).alias("direction")).withColumn("score", F.col("mean_distance") / 1000 + F.col("direction"))

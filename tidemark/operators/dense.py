"""Sums of matrices over tasks, and what is made of them: singular vectors of wide tables, and feature elimination.

Each task makes one array of its rows; arrays are added up in a tree, so that the driver gets a few of them, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import kept
from . import prefix


def summed(df: DataFrame, make: Callable[[Iterator[pd.DataFrame]], np.ndarray], fan: int = 16) -> np.ndarray:
    """The sum over tasks of the array that make() gives for a task's rows, as a flat array of doubles."""

    def run(batches):
        made = np.asarray(make(batches), dtype=float)
        yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "data": [made.tobytes()]})

    def merge(pdf):
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "data": [np.sum([np.frombuffer(x) for x in pdf["data"]], axis=0).tobytes()]})

    parts, n = df.mapInPandas(run, "slot long, data binary"), df.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.groupBy(F.pmod("slot", F.lit(n)).alias("slot")).applyInPandas(merge, "slot long, data binary")
    found = [np.frombuffer(r["data"]) for r in parts.select("data").collect()]  # fan at most
    return np.sum(found, axis=0)


def _rows(pdf: pd.DataFrame, column: str, width: int) -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.empty((0, width))


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def svd(df: DataFrame, key: str, values: Column, k: int, centred: bool = True, tolerance: float = 1e-12, most_passes: int = 100, most_columns: int = 400, seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key and components: the projections on the first k right singular vectors; singular values; vectors as columns) of the matrix
    whose rows are the arrays `values`, of equal length d; centred: about the columns' means. Each vector's largest entry is positive.

    A block Lanczos iteration from random directions: a pass over the rows gives X'(XQ) for a block Q of k + 10 columns; products of all
    blocks so far give the best approximation in their span, whose residuals are the next block. It ends when all k residuals are below
    tolerance times the largest squared value, or when the span is the whole space. The driver holds matrices of d rows and at most
    most_columns columns (beyond them it starts again from the best vectors), never one of d x d."""
    held = df.select(key, values.alias("v"))
    d = held.select(F.size("v").alias("n")).limit(1).first()
    if d is None or k < 1:
        raise ValueError("no rows, or no components")
    d = d["n"]

    def sums(batches):
        total = np.zeros(d + 1)
        for pdf in batches:
            total[0] += len(pdf)
            total[1:] += _rows(pdf, "v", d).sum(axis=0)
        return total

    means = np.zeros(d)
    if centred:
        total = summed(held.select("v"), sums)
        means = total[1:] / total[0]

    def product(q: np.ndarray) -> np.ndarray:
        def make(batches):
            total = np.zeros((d, q.shape[1]))
            for pdf in batches:
                x = _rows(pdf, "v", d) - means
                total += x.T @ (x @ q)
            return total

        return summed(held.select("v"), make).reshape(d, -1)

    def fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """An orthonormal block of what is new in block."""
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        return q[:, np.abs(np.diag(r)) > 1e-13 * max(1e-300, np.abs(r).max())] if block.size else block

    width = min(d, k + 10)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis, products = np.empty((d, 0)), np.empty((d, 0))
    for _ in range(most_passes):
        basis, products = np.hstack([basis, block]), np.hstack([products, product(block)])
        small = basis.T @ products
        theta, s = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(theta)[::-1][: max(width, 1)]
        theta, s = theta[order], s[:, order]
        best, images = basis @ s, products @ s
        rest = images - best * theta
        top = min(k, len(theta))
        if basis.shape[1] >= d or np.linalg.norm(rest[:, :top], axis=0).max() <= tolerance * max(theta[0], 1e-300):
            break
        if basis.shape[1] + width > max(most_columns, 3 * width):
            basis, products = best, images
        block = fresh(rest, basis)
        if not block.shape[1]:
            break
    vectors = best[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)

    def project(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "components": list((_rows(pdf, "v", d) - means) @ vectors)})

    return held.mapInPandas(project, f"`{key}` {held.schema[key].dataType.simpleString()}, components array<double>"), np.sqrt(np.maximum(theta[:k], 0)), vectors


def grams(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of products of (1, features, label) for each fold, about the means of all rows; those means), in two passes."""
    d = len(features) + 1
    names = [f"v{i}" for i in range(d)]
    held = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(v) for c, v in zip((*features, label), names, strict=True)])
    means = np.array([*df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate((*features, label))]).first()], dtype=float)

    def make(batches):
        total = np.zeros((folds, d + 1, d + 1))
        for pdf in batches:
            x = np.c_[np.ones(len(pdf)), pdf[names].to_numpy(float) - means]
            own = pdf["fold"].to_numpy()
            for k in np.unique(own):
                part = x[own == k]
                total[k] += part.T @ part
        return total

    return summed(held, make).reshape(folds, d + 1, d + 1), means


def eliminated(gram: np.ndarray, means: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """For d features down to one: (places kept, weights of all columns, the constant first) of least squares with those features. The weakest, by
    weight times deviation, goes each time: its row and column leave the inverse by one rank-one step, without another fit."""
    n, d = gram[0, 0], len(gram) - 2
    centre = gram[0, 1:] / n
    s = gram[1:, 1:] / n - np.outer(centre, centre)
    scale = np.sqrt(np.diag(s)[:d])
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(s[:d, :d] / np.outer(scale, scale), hermitian=True)
    beta, kept, out = inverse @ (s[:d, d] / scale), list(range(d)), []
    while kept:
        own = np.zeros(d + 1)
        own[[1 + i for i in kept]] = beta[kept] / scale[kept]
        own[0] = means[d] + centre[d] - own[1:] @ (means[:d] + centre[:d])
        out.append((list(kept), own))
        weakest = min(kept, key=lambda i: (abs(beta[i]), -i))
        p = inverse[weakest, weakest]
        if p > 1e-12:
            beta = beta - inverse[:, weakest] * (beta[weakest] / p)
            inverse = inverse - np.outer(inverse[:, weakest], inverse[weakest]) / p
        beta[weakest] = 0.0
        inverse[weakest], inverse[:, weakest] = 0.0, 0.0
        kept.remove(weakest)
    return out


def fold_answer(fold: str, features: Sequence[str], weights: np.ndarray) -> Column:
    """The answer of a row's fold's linear model; weights: fold by weight, the constant first."""
    of_fold = lambda w: F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(fold).cast("int") + 1)
    return sum((of_fold(weights[:, 1 + i]) * F.col(c).cast("double") for i, c in enumerate(features)), of_fold(weights[:, 0]))


def select_rfe(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, tie: str) -> DataFrame:
    """n_features, features (those that are left when all rows are used, in the given order), gini: for each number of features the
    normalised Gini of out-of-fold predictions, each fold's elimination made without the fold. Two passes give the sums of products, whatever the
    number of features; predictions are expressions, and the Gini of the labels themselves, the same for all steps, is made once. The best number is
    that of the largest gini, ties: the fewest."""
    df = kept(df.select(tie, label, fold, *features), "elimination")  # what makes the rows runs once, not for each pass
    own, means = grams(df, features, label, fold, folds)
    whole = own.sum(axis=0)
    final = eliminated(whole, means)
    models = np.stack([[w for _, w in eliminated(whole - own[k], means)] for k in range(folds)])  # fold, step, weights
    answers = F.array(*[fold_answer(fold, features, models[:, k]) for k in range(len(features))])
    long = df.select(F.col(tie).alias("tie"), F.col(label).cast("double").alias("y"), F.posexplode(answers).alias("step", "p"))
    scores = prefix.lorenz_gini(long, "y", "p", tie=["tie"], by=["step"])
    best = prefix.gini_at_best(df, label).select(F.col("gini").alias("best"))
    names = df.sparkSession.createDataFrame([(i, len(left), ",".join(features[j] for j in left)) for i, (left, _) in enumerate(final)], "step int, n_features long, features string")
    return names.join(scores, "step").crossJoin(F.broadcast(best)).select("n_features", "features", F.try_divide("gini", "best").alias("gini"))


def penalised(gram: np.ndarray, means: np.ndarray, alpha: float, share: float, tolerance: float = 1e-12, most: int = 100_000) -> np.ndarray:
    """Weights (the constant first) of least squares with a penalty of alpha on standardised weights, a share of it on their absolute values and the
    rest on half their squares (in terms of the standardised label, as Spark ML's LinearRegression has it): coordinate descent on the sums of
    products."""
    n, d = gram[0, 0], len(gram) - 2
    centre = gram[0, 1:] / n
    s = gram[1:, 1:] / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    scale[scale == 0] = np.inf  # a constant column has no weight
    s = s / np.outer(scale, scale)
    first, second = alpha * share / scale[d], alpha * (1 - share) / scale[d]
    if not first:
        b = np.linalg.pinv(s[:d, :d] + second * np.eye(d), hermitian=True) @ s[:d, d]
    else:
        b = np.zeros(d)
        for _ in range(most):
            old = b.copy()
            for j in range(d):
                if s[j, j]:
                    rest = s[j, d] - s[j, :d] @ b + s[j, j] * b[j]
                    b[j] = np.sign(rest) * max(abs(rest) - first, 0.0) / (s[j, j] + second)
            if np.abs(b - old).max() <= tolerance:
                break
    own = b * (scale[d] if np.isfinite(scale[d]) else 0.0) / scale[:d]
    return np.r_[means[d] + centre[d] - own @ (means[:d] + centre[:d]), own]


def linear_family(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, kinds: dict[str, tuple[float, float]], tie: str, weight: str | None = None) -> DataFrame:
    """kind, mae (of all rows), gini (mean over folds) and gini_cv (its deviation over the mean): linear models by kind (alpha, share: see penalised()),
    each row answered by the models fitted without its fold, scored by the normalised weighted Gini of each fold. Two passes give the sums of
    products of all folds, whatever the number of kinds."""
    df = kept(df.select(tie, label, fold, *features, *([weight] if weight else [])), "family")  # what makes the rows runs once, not for each pass
    own, means = grams(df, features, label, fold, folds)
    whole = own.sum(axis=0)
    fitted = {c: np.stack([penalised(whole - own[k], means, *how) for k in range(folds)]) for c, how in kinds.items()}
    answers = F.array(*[F.struct(F.lit(c).alias("kind"), fold_answer(fold, features, w).alias("p")) for c, w in fitted.items()])
    rows = df.select(F.col(tie).alias("tie"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), answers.alias("s"))
    long = rows.select("tie", "y", "fold", "w", F.inline("s"))
    mae = long.groupBy("kind").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    found = prefix.lorenz_gini(long, "y", "p", "w", ["tie"], ["kind", "fold"])
    best = prefix.gini_at_best(rows, "y", "w", ["fold"]).select("fold", F.col("gini").alias("best"))
    scored = found.join(best, "fold").groupBy("kind").agg(F.avg(F.try_divide("gini", "best")).alias("gini"), F.stddev_pop(F.try_divide("gini", "best")).alias("sd"))
    return mae.join(scored, "kind").select("kind", "mae", "gini", F.try_divide("sd", "gini").alias("gini_cv"))

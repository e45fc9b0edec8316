"""Cross-validation and parameter search. Folds are a column; scores of all folds come from one aggregate."""

from __future__ import annotations

import itertools
import math
import random
import threading
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import InheritableThread
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import pipeline


def out_of_fold(df: DataFrame, fold: str, folds: int, features: Sequence[str], label: str, make: Callable[[], object], key: str, classes: int | None = None, first: int = 0) -> DataFrame:
    """Of `folds` folds from `first` on: key, fold, label, prediction (and probabilities over all classes, 0 for those a fold's training rows lack). A fold whose training
    rows have one class gets that class. make gives a learner, or a whole pipeline."""
    out = None
    for k in range(first, first + folds):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        seen = [r[0] for r in train.select(label).distinct().limit(2).collect()]
        if len(seen) < 2:
            got = test.select(key, fold, label, F.lit(float(seen[0])).alias("prediction"), *([F.array(*[F.lit(float(c == seen[0])) for c in range(classes)]).alias("p")] if classes else []))
        else:
            learner = make()
            whole = learner if isinstance(learner, Pipeline) else pipeline(features, learner.setLabelCol(label))
            got = whole.fit(train).transform(test)
            p = vector_to_array("probability") if classes else None
            got = got.select(key, fold, label, "prediction", *([F.slice(F.concat(p, F.array_repeat(F.lit(0.0), classes)), 1, classes).alias("p")] if classes else []))
        out = got if out is None else out.unionByName(got)
    return out


def fold_sums(df: DataFrame, fold: str, label: str, columns: Mapping[str, Column]) -> DataFrame:
    """Sums of the columns by fold and label, in one pass: as many rows as folds times classes."""
    return df.groupBy(fold, label).agg(*[F.sum(c).alias(n) for n, c in columns.items()])


def bayes_out_of_fold(df: DataFrame, fold: str, folds: int, features: Sequence[str], label: str, keep: Sequence[str], weight: str | None = None) -> DataFrame:
    """keep, fold, prediction (a class), p (probabilities by ascending class) of every row by Gaussian naive Bayes of the other folds'
    weighted rows. One pass gives the sums of all folds; a fold's model is all sums less its own, so more folds cost no more passes. A
    billionth of the largest variance is added to variances. A class that a fold's training rows lack has probability 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = {f: F.col(f).cast("double") for f in features}
    wanted = {"n": w, **{f"s_{f}": w * c for f, c in x.items()}, **{f"q_{f}": w * c * c for f, c in x.items()}}
    held = df.where(F.col(label).isNotNull())
    rows = fold_sums(held, fold, label, wanted).collect()  # folds times classes
    classes = sorted({r[label] for r in rows})
    names = ["n", *[f"s_{f}" for f in features], *[f"q_{f}" for f in features]]
    sums = np.zeros((folds, len(classes), len(names)))
    for r in rows:
        sums[r[fold], classes.index(r[label])] = [r[n] for n in names]
    d, models = len(features), []
    for k in range(folds):
        own = sums.sum(axis=0) - sums[k]
        n, total = own[:, 0], own.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = own[:, 1 : d + 1] / n[:, None]
            extra = 1e-9 * (total[d + 1 :] / total[0] - (total[1 : d + 1] / total[0]) ** 2).max()
            models.append([(float(np.log(n[c] / total[0])) if n[c] > 0 else None, mean[c].tolist(), (own[c, d + 1 :] / n[c] - mean[c] ** 2 + extra).tolist()) for c in range(len(classes))])

    def score(c: int) -> Column:
        """Of class c by the model of the row's fold; models are a few numbers for each fold."""
        def pick(value) -> Column:
            return F.element_at(F.array(*[F.lit(value(m[c])) for m in models]).cast("array<double>"), F.col(fold).cast("int") + 1)

        terms = [F.pow(x[f] - pick(lambda m, i=i: m[1][i]), 2) / pick(lambda m, i=i: m[2][i]) + F.log(pick(lambda m, i=i: m[2][i])) for i, f in enumerate(features)]
        return F.coalesce(pick(lambda m: m[0]) - 0.5 * sum(terms[1:], terms[0]), F.lit(float("-inf")))

    scored = df.withColumn("__lp", F.array(*[score(c) for c in range(len(classes))])).withColumn("__top", F.array_max("__lp"))
    e = scored.withColumn("__e", F.transform("__lp", lambda v: F.exp(v - F.col("__top"))))
    p = F.transform("__e", lambda v: v / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
    values = F.array(*[F.lit(c) for c in classes])
    return e.select(*keep, fold, F.element_at(values, F.array_position("__e", F.array_max("__e")).cast("int")).alias("prediction"), p.alias("p"))


def cross_val_score(scored: DataFrame, fold: str, score: Column) -> DataFrame:
    """fold, score of an out-of-fold table, any aggregate as the score."""
    return scored.groupBy(fold).agg(score.alias("score"))


def grid(parameters: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(parameters, v, strict=True)) for v in itertools.product(*parameters.values())]


def grid_search(df: DataFrame, fold: str, folds: int, features: Sequence[str], label: str, make: Callable[[dict], object], parameters: Mapping[str, Sequence], score: Column, key: str) -> list[tuple[dict, float]]:
    """All combinations with their mean fold score, best first."""
    found = [(p, _mean(df, fold, folds, features, label, make, p, score, key)) for p in grid(parameters)]
    return sorted(found, key=lambda x: (-x[1], str(x[0])))


def _mean(df, fold, folds, features, label, make, p, score, key) -> float:
    scored = out_of_fold(df, fold, folds, features, label, lambda: make(p), key)
    return float(cross_val_score(scored, fold, score).agg(F.avg("score")).first()[0])


def fold_score(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str, make: Callable[[], object], score: Column, key: str) -> float:
    """Score of one fold: fitted on the others."""
    held = out_of_fold(df, fold, 1, features, label, make, key, first=k)
    return float(held.agg(score.alias("score")).first()["score"])


@dataclass(frozen=True)
class Span:
    """A range of numbers; whole: of whole ones; sd: by how much of itself a number is changed at a time (x times 1 + normal * sd)."""

    low: float
    high: float
    whole: bool = False
    sd: float = 0.2

    def held(self, x: float) -> float:
        x = min(max(x, self.low), self.high)
        return round(x) if self.whole else float(f"{x:.6g}")


def _drawn(rng: random.Random, space: Sequence | Span) -> object:
    return space.held(rng.uniform(space.low, space.high)) if isinstance(space, Span) else rng.choice(list(space))


def _changed(rng: random.Random, space: Sequence | Span, x: object) -> object:
    """A number of a span times 1 + normal * sd (0 takes a step of the span); another one of a list, nearer ones likelier where it has numbers."""
    if isinstance(space, Span):
        new = space.held(x * (1 + rng.gauss(0, space.sd)) if x else rng.gauss(0, space.sd) * (space.high - space.low))
        return space.held(new + rng.choice((-1, 1))) if space.whole and new == x else new
    others = [o for o in space if o != x]
    if others and all(isinstance(o, (int, float)) for o in space):
        at = {o: i for i, o in enumerate(sorted(space))}
        return rng.choices(others, [1 / abs(at[o] - at[x]) ** 2 for o in others])[0]
    return rng.choice(others) if others else x


class Trials:
    """Scores of candidates by fold, each fold a Spark job of its own, at most at_once of them at a time, in fair pools where the session
    schedules fairly. A candidate whose folds so far rule out the score asked for, given the most that a fold can score, is
    hopeless, and its jobs are cancelled; one that falls short of it with all its folds counts as hopeless, too, so results don't depend
    on what was cancelled. A score is the mean over folds; one without a value (an evaluation that fails to give one) is the worst."""

    def __init__(self, evaluate: Callable[[dict, int], float | None], folds: int, spark: SparkSession | None = None, at_once: int = 4, most: float | None = None) -> None:
        self.evaluate, self.folds, self.spark, self.at_once, self.most = evaluate, folds, spark, max(1, at_once), most
        self.scores: dict[tuple, float] = {}
        self.hopeless: dict[tuple, float] = {}
        self.jobs = 0

    def run(self, candidates: Sequence[dict], least: float = -math.inf) -> list[float]:
        """Scores in the candidates' order, -inf for hopeless ones. What was scored before isn't run again."""
        keys = [tuple(c.values()) for c in candidates]
        new = {k: c for k, c in zip(keys, candidates, strict=True) if k not in self.scores and self.hopeless.get(k, math.inf) > least}
        lock, parts, stopped, running = threading.Lock(), {k: {} for k in new}, set(), Counter()

        def one(key: tuple, fold: int) -> None:
            with lock:
                if key in stopped:
                    return
                self.jobs += 1
                running[key] += 1
            tag = f"trial-{id(self)}-{abs(hash(key))}"
            if self.spark is not None:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", tag)
                self.spark.addTag(tag)
            try:
                got = self.evaluate(new[key], fold)
            except Exception:
                with lock:
                    if key in stopped:  # cancelled
                        return
                raise
            finally:
                with lock:
                    running[key] -= 1
                if self.spark is not None:
                    self.spark.removeTag(tag)
                    self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            with lock:
                parts[key][fold] = -math.inf if got is None else got
                found = parts[key]
                done = sum(found[f] for f in sorted(found))
                bound = math.inf if self.most is None and len(found) < self.folds else (done + (self.folds - len(found)) * (self.most or 0)) / self.folds
                if bound < least:
                    stopped.add(key)

        thread = InheritableThread if self.spark is not None else threading.Thread
        work = [(k, f) for f in range(self.folds) for k in new]
        turn, failed = iter(work), []

        def worker() -> None:
            while not failed:
                with lock:
                    job = next(turn, None)
                if job is None:
                    return
                try:
                    one(*job)
                except Exception as e:  # given on below
                    failed.append(e)

        workers = [thread(target=worker) for _ in range(min(self.at_once, len(work)))]
        for w in workers:
            w.start()
        while any(w.is_alive() for w in workers):
            for w in workers:
                w.join(0.1)
            with lock:
                late = [k for k in stopped if running[k]]
            for k in late if self.spark is not None else []:  # again and again: its next job may not have begun yet
                self.spark.interruptTag(f"trial-{id(self)}-{abs(hash(k))}")
        if failed:
            raise failed[0]
        for k, found in parts.items():
            if k in stopped:
                self.hopeless[k] = least
            else:
                self.scores[k] = sum(found[f] for f in range(self.folds)) / self.folds
        return [self.scores.get(k, -math.inf) for k in keys]


def search_genetic(evaluate: Callable[..., float | None] | Trials, parameters: Mapping[str, Sequence | Span], population: int = 8, elite: int = 2, parents: float = 0.5, steps: int = 6, mutation: float = 0.2, seed: int = 7, first: Sequence[dict] = ()) -> tuple[dict, float, dict]:
    """Best parameters, their score, and all scores met. parameters: lists of values, or spans of numbers; evaluate: a function of a candidate,
    or Trials. The first population is `first`, then random. The `elite` best stay; the others are children of two of the best share
    `parents`, each parameter from either, changed with probability `mutation` (more while nothing gets better). Children met before are drawn anew, up to
    twenty times. A child that can't reach the worst parent's score is hopeless, for Trials to cut short. All draws are made before a
    generation is scored, so the result doesn't depend on how many run at once."""
    trials = evaluate if isinstance(evaluate, Trials) else Trials(lambda p, _: evaluate(p), 1, at_once=1)
    rng, names = random.Random(seed), list(parameters)
    as_dict = lambda v: dict(zip(names, v, strict=True))
    met: dict[tuple, float] = {}

    def score(new: Sequence[tuple], least: float) -> None:
        met.update(zip(new, trials.run([as_dict(v) for v in new], least), strict=True))

    now = list(dict.fromkeys(tuple(p[n] for n in names) for p in first))[:population]
    for _ in range(population * 20):
        if len(now) == population:
            break
        v = tuple(_drawn(rng, parameters[n]) for n in names)
        now += [v] if v not in now else []
    score(now, -math.inf)
    best, rate, stuck = max(met.values()), mutation, 0
    for _ in range(steps):
        now.sort(key=lambda v: (-met[v], str(v)))
        pool = now[: max(2, round(parents * population))]
        new: list[tuple] = []
        while len(new) < population - elite:
            for _ in range(20):
                a, b = rng.choice(pool), rng.choice(pool)
                child = tuple(rng.choice(pair) for pair in zip(a, b, strict=True))
                child = tuple(_changed(rng, parameters[n], x) if rng.random() < rate else x for n, x in zip(names, child, strict=True))
                if child not in met and child not in new:
                    break
            else:
                break
            new.append(child)
        if not new:
            break
        score(new, met[pool[-1]])
        now = now[:elite] + new
        top = max(met.values())
        stuck, rate = (0, mutation) if top > best else (stuck + 1, min(1.0, rate * 1.3))
        best = max(best, top)
        if stuck >= 4:
            break
    winner = max(met, key=lambda v: (met[v], str(v)))
    return as_dict(winner), met[winner], met


def best_of(df: DataFrame, fold: str, folds: int, features: Sequence[str], label: str, learners: Mapping[str, Callable[[], object]], score: Column, key: str) -> list[tuple[str, float]]:
    """Several learners by their mean fold score, best first."""
    found = [(name, _mean(df, fold, folds, features, label, lambda p, m=make: m(), {}, score, key)) for name, make in learners.items()]
    return sorted(found, key=lambda x: (-x[1], x[0]))

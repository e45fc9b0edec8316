"""Genetic search over numbers and lists, at any parallelism."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search


def test_spans_and_lists_at_any_parallelism():
    """Same best, same candidates met, whatever runs at once; numbers stay inside their spans."""
    found = []
    for at_once in (1, 3, 8):
        running, most, lock = [0], [0], threading.Lock()

        def evaluate(p, fold):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.001 * (hash((p["x"], fold)) % 5))
            with lock:
                running[0] -= 1
            assert -2 <= p["x"] <= 3 and 1 <= p["n"] <= 40 and isinstance(p["n"], int)
            return 1 - (p["x"] - 1.7) ** 2 / 30 - (p["n"] - 30) ** 2 / 2000 - (p["kind"] != "b") * 0.1 + fold * 1e-3 - 1e-3

        trials = search.Trials(evaluate, 3, at_once=at_once, most=1.002)
        best, value, met = search.search_genetic(trials, {"x": search.Span(-2, 3), "n": search.Span(1, 40, whole=True), "kind": ["a", "b", "c"]}, population=12, steps=12, seed=3)
        assert best["kind"] == "b" and value > 0.97 and most[0] <= at_once
        found.append((best, value, met))
    assert found[0] == found[1] == found[2]


def test_best_of_a_grid_in_fewer_evaluations():
    met = []
    for seed in range(5):
        calls = []

        def score(p):
            calls.append(tuple(p.values()))
            return -((p["a"] - 11) ** 2) - (p["b"] - 3) ** 2

        best, value, scores = search.search_genetic(score, {"a": list(range(15)), "b": list(range(15))}, population=16, elite=4, parents=0.4, steps=12, mutation=0.3, seed=seed)
        assert len(calls) == len(set(calls)) == len(scores) < 225
        met.append(value)
    assert max(met) == 0 and min(met) >= -5


def test_first_population_and_missing_scores():
    best, value, met = search.search_genetic(lambda p: None if p["a"] > 2 else p["a"], {"a": [0, 1, 2, 3, 4, 5]}, population=3, steps=0, first=[{"a": 2}, {"a": 5}])
    assert best == {"a": 2} and value == 2 and met[(5,)] == float("-inf") and len(met) == 3


def test_hopeless_jobs_are_cancelled(spark):
    """A slow fold of a candidate that can't get there any more ends early; others are left alone."""
    def evaluate(p, fold):
        if fold == 0:
            return float(p["good"])
        slow = F.udf(lambda i: time.sleep(1) or i, "long")
        return float(spark.range(0, 40, 1, 2).select(slow("id").alias("i")).agg(F.count("i") * 0 + 1.0).first()[0]) if not p["good"] else 1.0

    trials = search.Trials(evaluate, 2, spark, at_once=4, most=1.0)
    began = time.time()
    assert trials.run([{"good": 1}, {"good": 0}], least=0.9) == [1.0, float("-inf")]
    assert time.time() - began < 15  # 20 seconds if it ran to its end
    assert trials.run([{"good": 1}], least=0.9) == [1.0] and trials.jobs <= 4
    with pytest.raises(ZeroDivisionError):
        search.Trials(lambda p, f: 1 / 0, 2, spark).run([{"a": 1}])

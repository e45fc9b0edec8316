"""Models of all segments at once against one tree, one naive Bayes and one choice at a time."""

from collections import Counter

import numpy as np
import pytest

from tidemark.operators import segments


def plain_tree(x, y, classes, depth, least):
    """Nested (feature, cut, left, right), or a class."""
    n = Counter(y)
    answer = max(range(classes), key=lambda c: (n[c], -c))
    cost = lambda v: len(v) - sum(k * k for k in Counter(v).values()) / len(v)
    if not depth:
        return answer
    tried = [(round(cost(a) + cost(b), 9), f, c) for f in range(x.shape[1]) for c in sorted(set(x[:, f])) for a, b in [(y[x[:, f] <= c].tolist(), y[x[:, f] > c].tolist())] if min(len(a), len(b)) >= least]
    if not tried or min(tried)[0] >= round(cost(y.tolist()), 9):
        return answer
    _, f, c = min(tried)
    left = x[:, f] <= c
    return f, c, plain_tree(x[left], y[left], classes, depth - 1, least), plain_tree(x[~left], y[~left], classes, depth - 1, least)


def answer(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_bayes(x, y, classes):
    top = max(x.var(axis=0).max(), 1e-9)
    parts = {c: (np.log((y == c).sum()), x[y == c].mean(axis=0), x[y == c].var(axis=0) + 1e-9 * top) for c in range(classes) if (y == c).any()}
    score = lambda row, p: p[0] - 0.5 * (((row - p[1]) ** 2) / p[2] + np.log(p[2])).sum()
    return lambda row: max(parts, key=lambda c: (score(row, parts[c]), -c))


@pytest.mark.parametrize("rows", [700])
def test_equal_to_one_at_a_time(spark, rows):
    rng = np.random.default_rng(4)
    g = np.where(rng.random(rows) < 0.4, 0, rng.integers(0, 25, rows))  # one segment has two fifths of the rows
    x = rng.integers(0, 6, (rows, 2)).astype(float)
    y = (np.where(g % 3 == 0, x[:, 0] > 2, np.where(g % 3 == 1, (x[:, 0] > 1) ^ (x[:, 1] > 3), 0)) + (rng.random(rows) < 0.1)).astype(int) % 3
    data = [(i, int(g[i]) if g[i] < 24 else None, float(x[i, 0]), float(x[i, 1]), "abc"[y[i]]) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, g long, p double, q double, y string").repartition(4)
    cuts = {"p": [1.0, 2.0, 3.0, 4.0, 5.0], "q": [1.0, 2.0, 3.0, 4.0, 5.0]}
    models, classes, _ = segments.fit(df, ["g"], "y", ["p", "q"], "id", depth=3, least=2, folds=3, cuts=cuts)
    assert classes == ["a", "b", "c"] and models.count() == len({r[1] for r in data})
    got = {r.id: (r.learner, r.prediction) for r in segments.by_segment(df, df, ["g"], "y", ["p", "q"], "id", depth=3, least=2, folds=3, cuts=cuts).collect()}
    fold = np.arange(rows) % 3
    assert {v[0] for v in got.values()} == {"common", "bayes", "tree"}
    for s in set(g.tolist()):
        own = g == s

        def learned(train):
            n = np.bincount(y[train], minlength=3)
            tree, bayes = plain_tree(x[train], y[train], 3, 3, 2), plain_bayes(x[train], y[train], 3)
            return {"common": lambda row: int(n.argmax()), "bayes": bayes, "tree": lambda row: answer(tree, row)}

        hits = Counter({k: 0 for k in segments.LEARNERS})
        for k in range(3):
            if (own & (fold != k)).any():
                made = learned(own & (fold != k))
                for i in np.flatnonzero(own & (fold == k)):
                    hits.update({name: int(f(x[i]) == y[i]) for name, f in made.items()})
        best = max(segments.LEARNERS, key=lambda c: (hits[c], -segments.LEARNERS.index(c)))
        final = learned(own)[best]
        assert all(got[i] == (best, "abc"[final(x[i])]) for i in np.flatnonzero(own).tolist())


def test_thousands_of_segments_in_few_passes(spark):
    """The number of jobs is that of one segment; rows of unseen segments and without features get the most frequent label."""
    made = spark.range(12_000).selectExpr("id", "id % 3000 AS g", "CAST(id div 3000 AS DOUBLE) AS p", "CAST(id % 7 AS DOUBLE) AS q", "CAST((id div 3000) % 2 AS DOUBLE) AS y")

    def jobs(df, name):
        spark.sparkContext.setJobGroup(name, "")
        out = segments.by_segment(df, df, ["g"], "y", ["p", "q"], "id", ("common", "tree"), depth=2, least=1, folds=2, cuts={"p": [1.0, 2.0, 3.0], "q": [3.0]})
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        return out, n

    out, many = jobs(made, "many")
    assert out.count() == 12_000 and out.select("learner").distinct().count() <= 2
    assert many <= jobs(made.where("g < 2"), "two")[1] + 12
    other = spark.createDataFrame([(1, 99_999, 1.0, 1.0), (2, 5, None, 1.0)], "id long, g long, p double, q double")
    assert {(r.id, r.learner, r.prediction) for r in segments.by_segment(made, other, ["g"], "y", ["p", "q"], "id", ("common",)).collect()} == {(1, None, 0.0), (2, None, 0.0)}
    assert segments.by_segment(made.limit(0), other, ["g"], "y", ["p", "q"], "id").where("prediction IS NULL").count() == 2

"""A model for each segment, thousands of segments at once.

Features are binned once; rows become counts by (fold, segment, bins, class), so a segment is never brought together, however many rows it
has. A tree grows for all segments at the same time: each level is one sum by (segment, node, feature, bin, class), running sums over the
bins give every split's impurity, and the counts move on to their child nodes. Naive Bayes is one sum by (segment, class). The learner of a
segment is chosen by its accuracy on held-out folds, which are trained in the same passes: fold k is the segment without its rows of fold k.
So the number of passes depends on the depth only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from .relational import small

#: In this order when segments' accuracies tie.
LEARNERS = ("common", "bayes", "tree")
#: Impurities are compared at so many decimal places.
PLACES = 9
ALL = -1  # the fold of models that are trained on all rows


def cuts_of(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Cut points of each feature at its approximate quantiles: bins - 1 at most."""
    one = df.agg(*[F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(one[f] or [])) for f in features}


def bin_of(feature: str, cuts: Sequence[float]) -> Column:
    """How many cuts are at or below the value (nulls: none)."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: F.col(feature) >= c))


def _labels(train: DataFrame, label: str, most: int = 100) -> list:
    found = [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} classes")
    return found


def _argmax(counts: str) -> Column:
    """Place of the largest count; ties: the first."""
    return F.array_position(F.col(counts), F.array_max(counts)).cast("int") - 1


def _vector_sum(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def trees(counts: DataFrame, by: Sequence[str], bins: Sequence[str], classes: int, depth: int, least: int) -> DataFrame:
    """by, nodes: map from node (1: the root, 2n and 2n + 1: children of n) to (feature: place in bins or null, cut: last bin of the left
    child, answer: place of the class). counts: by, bins, n (array: rows of each class). A node is split where the children's impurity
    (rows times Gini) is least, if that is less than its own and both have at least `least` rows; ties: first feature, then cut."""
    size = lambda c: reduce(lambda a, b: a + b, [F.col(c)[i] for i in range(classes)])
    impurity = lambda c: F.col(f"__{c}") - reduce(lambda a, b: a + b, [F.col(c)[i] * F.col(c)[i] for i in range(classes)]) / F.col(f"__{c}")
    held, levels = counts.withColumn("node", F.lit(1)), []
    for level in range(depth + 1):
        own = held.groupBy(*by, "node").agg(_vector_sum("n", classes).alias("n"))
        if level == depth:
            levels.append(own.select(*by, "node", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("cut"), _argmax("n").alias("answer")))
            break
        each = held.select(*by, "node", "n", F.posexplode(F.array(*bins)).alias("feature", "bin"))
        sums = each.groupBy(*by, "node", "feature", "bin").agg(_vector_sum("n", classes).alias("n"))
        upto = Window.partitionBy(*by, "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
        run = sums.select(*by, "node", "feature", "bin", F.array(*[F.sum(F.col("n")[i]).over(upto) for i in range(classes)]).alias("left"))
        both = run.join(own.withColumnRenamed("n", "whole"), [*by, "node"]).withColumn("right", F.array(*[F.col("whole")[i] - F.col("left")[i] for i in range(classes)]))
        both = both.withColumns({f"__{c}": size(c).cast("double") for c in ("left", "right", "whole")})
        split = both.where((F.col("__left") >= least) & (F.col("__right") >= least)).withColumn("cost", F.round(impurity("left") + impurity("right"), PLACES)).where(F.col("cost") < F.round(impurity("whole"), PLACES))
        best = split.groupBy(*by, "node").agg(F.min(F.struct("cost", "feature", "bin")).alias("best"))
        nodes = kept(own.join(best, [*by, "node"], "left").select(*by, "node", F.col("best.feature").cast("int").alias("feature"), F.col("best.bin").cast("int").alias("cut"), _argmax("n").alias("answer")), "nodes")
        levels.append(nodes)
        moved = held.join(nodes.where("feature IS NOT NULL").drop("answer"), [*by, "node"])
        right = F.element_at(F.array(*bins), F.col("feature") + 1) > F.col("cut")
        held = kept(moved.withColumn("node", 2 * F.col("node") + right.cast("int")).groupBy(*by, *bins, "node").agg(_vector_sum("n", classes).alias("n")), "counts")
    whole = reduce(DataFrame.unionByName, levels)
    return whole.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut", "answer")))).alias("nodes"))  # at most 2 ** (depth + 1) nodes


def tree_answer(nodes: Column, bins: Sequence[str], depth: int) -> Column:
    """Place of the class that a segment's tree gives a row with these bins."""
    node = F.lit(1)
    for _ in range(depth):
        at = nodes[node]
        right = F.element_at(F.array(*bins), at["feature"] + 1) > at["cut"]
        node = F.when(at["feature"].isNotNull(), 2 * node + right.cast("int")).otherwise(node)
    return nodes[node]["answer"]


def bayes(train: DataFrame, by: Sequence[str], features: Sequence[str], code: str, classes: int) -> DataFrame:
    """by, bayes: array by class of (n, means, variances): Gaussian naive Bayes of each segment, null where a class is missing. A
    billionth of the segment's largest variance is added to variances, and a billionth of that, so that none is 0."""
    sums = train.groupBy(*by, code).agg(F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("means"), F.array(*[F.var_pop(f) for f in features]).alias("variances"))
    whole = train.groupBy(*by).agg(F.greatest(*[F.var_pop(f) for f in features], F.lit(1e-9)).alias("__top"))
    own = sums.join(whole, list(by)).withColumn("variances", F.transform("variances", lambda v: v + 1e-9 * F.col("__top")))
    found = own.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(code, F.struct("n", "means", "variances")))).alias("m"))  # a row for each class
    return found.select(*by, F.array(*[F.col("m")[F.lit(c)] for c in range(classes)]).alias("bayes"))


def bayes_answer(model: str, features: Sequence[str], classes: int) -> Column:
    def score(c: int) -> Column:
        own = F.col(model)[c]
        terms = [F.pow(F.col(f) - own["means"][i], 2) / own["variances"][i] + F.log(own["variances"][i]) for i, f in enumerate(features)]
        return F.coalesce(F.log(own["n"]) - 0.5 * reduce(lambda a, b: a + b, terms), F.lit(float("-inf")))

    scores = F.array(*[score(c) for c in range(classes)])
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def fit(train: DataFrame, segments: Sequence[str], label: str, features: Sequence[str], key: str, learners: Sequence[str] = LEARNERS, depth: int = 4, least: int = 3, folds: int = 3, cuts: Mapping[str, Sequence[float]] | None = None) -> tuple[DataFrame, list, Mapping[str, Sequence[float]]]:
    """(segments, learner, accuracy, common, nodes, bayes of each segment; the classes; the cuts). Rows without a label or a feature are
    left out; null segments are segments like others."""
    cuts = cuts or cuts_of(train, features)
    classes = _labels(train, label)
    own, bins = [f"__s{i}" for i in range(len(segments))], [f"__b{i}" for i in range(len(features))]
    by = ["__fold", *own]
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    held = train.where(F.col(label).isNotNull() & reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])).select(
        F.col(key).alias("__key"), *[F.coalesce(F.to_json(F.struct(F.col(s).alias("v"))), F.lit("")).alias(o) for s, o in zip(segments, own, strict=True)], *[F.col(f).cast("double").alias(f) for f in features], *[bin_of(f, cuts[f]).alias(b) for f, b in zip(features, bins, strict=True)], code.alias("__code"), F.pmod(F.col(key) if dict(train.dtypes)[key] in ("int", "bigint") else F.xxhash64(key), F.lit(folds)).cast("int").alias("__own")
    )
    held = kept(held, "segments")
    copies = held.withColumn("__fold", F.explode(F.array(*[F.lit(k) for k in (ALL, *range(folds))]))).where("__fold <> __own")
    n = len(classes)
    one = F.array(*[F.sum((F.col("__code") == c).cast("long")) for c in range(n)]).alias("n")
    counts = kept(copies.groupBy(*by, *bins).agg(one), "counts")
    models = counts.groupBy(*by).agg(_vector_sum("n", n).alias("n")).select(*by, _argmax("n").alias("common"))
    models = models.join(trees(counts, by, bins, n, depth, least), by) if "tree" in learners else models
    models = kept(models.join(bayes(copies, by, features, "__code", n), by) if "bayes" in learners else models, "models")
    tested = held.withColumnRenamed("__own", "__fold").join(small(models), by, "left")
    hit = {x: F.sum((_answer(x, features, bins, n, depth) == F.col("__code")).cast("long")) for x in learners}
    scores = tested.groupBy(*own).agg(F.count("*").alias("__n"), *[F.coalesce(h, F.lit(0)).alias(x) for x, h in hit.items()])
    best = F.array_max(F.array(*[F.struct(F.col(x).alias("hit"), F.lit(-i).alias("place"), F.lit(x).alias("learner")) for i, x in enumerate(learners)]))
    chosen = scores.select(*own, best["learner"].alias("learner"), (best["hit"] / F.col("__n")).alias("accuracy"))
    return kept(models.where(F.col("__fold") == ALL).drop("__fold").join(chosen, own), "segment-models"), classes, cuts


def _answer(learner: str, features: Sequence[str], bins: Sequence[str], classes: int, depth: int) -> Column:
    return {"common": lambda: F.col("common"), "bayes": lambda: bayes_answer("bayes", features, classes), "tree": lambda: tree_answer(F.col("nodes"), bins, depth)}[learner]()


def by_segment(train: DataFrame, test: DataFrame, segments: Sequence[str], label: str, features: Sequence[str], key: str, learners: Sequence[str] = LEARNERS, depth: int = 4, least: int = 3, folds: int = 3, cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """key, learner, prediction. Rows of a segment that train lacks, and rows without a feature, get the most frequent label of all
    (learner: null); without labels all predictions are null."""
    if not _labels(train, label):
        return test.select(key, F.lit(None).cast("string").alias("learner"), F.lit(None).cast(train.schema[label].dataType).alias("prediction"))
    models, classes, cuts = fit(train, segments, label, features, key, learners, depth, least, folds, cuts)
    own, bins = [f"__s{i}" for i in range(len(segments))], [f"__b{i}" for i in range(len(features))]
    overall = train.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("v")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).first()["m"]
    asked = test.select(key, *[F.coalesce(F.to_json(F.struct(F.col(s).alias("v"))), F.lit("")).alias(o) for s, o in zip(segments, own, strict=True)], *[F.col(f).cast("double").alias(f) for f in features], *[bin_of(f, cuts[f]).alias(b) for f, b in zip(features, bins, strict=True)])
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    found = asked.join(small(models), own, "left").withColumn("learner", F.when(whole, F.col("learner")))
    place = reduce(lambda made, x: made.when(F.col("learner") == x, _answer(x, features, bins, len(classes), depth)), learners, F.when(F.col("learner").isNull(), F.lit(None).cast("int")))
    values = F.array(*[F.lit(c) for c in classes])
    return found.select(key, "learner", F.coalesce(F.get(values, place), F.lit(overall["v"])).alias("prediction"))

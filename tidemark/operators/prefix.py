"""Running sums over a whole table without a window in one task, and what is made of them.

The table is cut into key ranges; sums by range are few rows, whose running total is joined back, and a window within
each range does the rest. A value so frequent that it is a cut itself has a range of its own, which is cut again by the first
tie column. So ranks, distribution functions, order statistics, Lorenz curves, ROC curves and AUC hold at any size and skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .relational import small


def ranges(df: DataFrame, order: str, parts: int | None = None) -> tuple[list, list]:
    """At most parts - 1 cut points of a numeric column, as many as there are partitions, whatever the input's size; and those of
    them that are values with more rows than a range should have."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return [], []
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []
    return sorted(set(found)), sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})


def _range_of(key: Column, cuts: list, lo: int = 0, hi: int | None = None) -> Column:
    """How many cuts are at or below key, by a tree of comparisons; nulls: 0."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key >= F.lit(cuts[mid]), _range_of(key, cuts, mid + 1, hi)).otherwise(_range_of(key, cuts, lo, mid))


def global_prefix_sum(df: DataFrame, order: str, columns: Sequence[str], descending: bool = False, tie: Sequence[str] = (), cuts: list | None = None, by: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """df with before_<c> for each column: the sum of c over all rows (of the same group, with by) that come before by (order, tie);
    with totals also total_<c>, the sum over all of them. Groups may be few and large: they are cut into the same ranges."""
    cuts, heavy = ranges(df, order) if cuts is None else (cuts, [])
    part = _range_of(F.col(order), cuts)
    if heavy:
        single = F.coalesce(F.col(order).isin(heavy), F.lit(False))  # all rows of the range have one value
        part = 2 * part - single.cast("int")
    if descending:
        part = -part
    if heavy and tie and isinstance(df.schema[tie[0]].dataType, (NumericType, StringType)):
        tied = df.where(single & F.col(tie[0]).isNotNull())
        within = ranges(tied, tie[0])[0] if isinstance(df.schema[tie[0]].dataType, NumericType) else text_ranges(tied.select(tie[0]).distinct(), tie[0])
        part = part * (len(within) + 1) + F.when(single, _range_of(F.col(tie[0]), within)).otherwise(0)
    held = df
    held = held.withColumn("__part", part.cast("long"))
    sums = held.groupBy(*by, "__part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{c}") for c in columns])
    # a group has a row for each range, so these windows are over few rows
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__part", *[F.coalesce(F.sum(f"__s_{c}").over(upto), F.lit(0)).alias(f"__b_{c}") for c in columns], *([F.sum(f"__s_{c}").over(group).alias(f"total_{c}") for c in columns] if totals else []))
    key = F.col(order).desc() if descending else F.col(order).asc()
    own = Window.partitionBy(*by, "__part").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "__part"]])
    out = out.alias("h").join((small(sums) if by else F.broadcast(sums)).alias("s"), same)
    kept = [f"h.`{c}`" for c in df.columns]
    return out.select(*kept, *[(F.col(f"h.before_{c}") + F.col(f"s.__b_{c}")).alias(f"before_{c}") for c in columns], *([f"s.total_{c}" for c in columns] if totals else []))


def percentiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, and p: array of exact percentiles (at: 0 to 1) by linear interpolation, null without values. Values are counted, and
    the counts' running sums tell which value stands at a place; no task holds all values of a group."""
    counts = df.select(*by, F.col(column).cast("double").alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("n"))
    run = global_prefix_sum(counts.where(F.col("__v").isNotNull()), "__v", ["n"], by=by, totals=True)
    place = [F.lit(float(x)) * (F.col("total_n") - 1) for x in at]
    value = lambda i: F.max(F.when((F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n")), F.col("__v")))
    one = run.groupBy(*by).agg(*[x for k, q in enumerate(place) for x in (value(F.floor(q)).alias(f"__l{k}"), value(F.ceil(q)).alias(f"__h{k}"))], F.max("total_n").alias("total_n"))
    share = [q - F.floor(q) for q in place]
    found = one.select(*by, F.array(*[F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * s for k, s in enumerate(share)]).alias("p"))
    if not by:
        return found
    groups = counts.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by])
    return groups.join(found, same, "left").select(*[F.col(f"__{c}").alias(c) for c in by], "p")


def most_frequent(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by, and mode: the smallest of the most frequent values; null without values."""
    counts = df.groupBy(*by, column).agg(F.count(column).alias("__n"))
    return counts.groupBy(*by).agg(F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v"))))["v"].alias("mode"))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, value (double): a row for each of the columns of each row."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """column, n, below (rows with a smaller value), place (distinct smaller values): one row for each value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    return global_prefix_sum(counts, column, ["n", "one"]).select(column, "n", F.col("before_n").alias("below"), F.col("before_one").alias("place"))


def rank_as_quantile(df: DataFrame, column: str, out: str) -> DataFrame:
    """The number of strictly smaller values of each row's value."""
    return df.join(value_ranks(df, column).select(column, F.col("below").alias(out)), column, "left")


def empirical_cdf(df: DataFrame, column: str, out: str) -> DataFrame:
    """The share of values at or below each row's."""
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("__total"))
    ranks = value_ranks(df, column).crossJoin(F.broadcast(total))
    return df.join(ranks.select(column, ((F.col("below") + F.col("n")) / F.col("__total")).alias(out)), column, "left")


def text_ranges(values: DataFrame, column: str, sample: int = 10_000) -> list[str]:
    """Cut points of distinct strings, from the `sample` of them with the smallest hashes: as many as there are partitions."""
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sorted(r[0].encode() for r in values.orderBy(F.xxhash64(column)).limit(sample).select(column).collect())
    return [x.decode() for x in dict.fromkeys(rows[len(rows) * i // parts] for i in range(1, parts))] if rows else []


def integerize(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """column, code: place of each value among the sorted distinct values of all frames. Values of any type."""
    values = frames[0].select(column)
    for f in frames[1:]:
        values = values.union(f.select(column))
    values = values.where(F.col(column).isNotNull()).distinct()
    if dict(values.dtypes)[column] != "string":
        return value_ranks(values, column).select(column, F.col("place").alias("code"))
    ranked = global_prefix_sum(values.withColumn("__one", F.lit(1).cast("long")), column, ["__one"], cuts=text_ranges(values, column))
    return ranked.select(column, F.col("before___one").alias("code"))


#: Rows that a task ranks at once, about.
RANKED = 1 << 21


def lorenz_gini(df: DataFrame, actual: str, predicted: str, weight: str | None = None, tie: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """by, gini: by descending prediction, sum of L(i+1)R(i) - L(i)R(i+1) over the curves of weight share R and loss share L. L(i) is a sum
    of the losses l before, so all terms with one l add up to l (2 W + w - total W), where W is the weight before it. Rows are exchanged once, by ranges of
    (by, prediction, tie) that are as many as the rows need; a task ranks its range in arrays and gives a row for each group, and W before it is added to that."""
    types = dict(df.select(*by).dtypes)
    ties = [f"t{i}" for i in range(len(tie))]
    a, w = F.col(actual).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.select(*by, F.col(predicted).cast("double").alias("p"), *[F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)], w.alias("w"), (a * w).alias("l"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANKED))
    names = [*by, "part", "s", "w", "l"]

    def rank(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        column = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        group = np.zeros(rows.num_rows, dtype=np.int64)
        for c in by:
            codes, found = pd.factorize(column(c), use_na_sentinel=False)
            group = group * len(found) + codes
        order = np.lexsort((*[column(c) for c in reversed(ties)], -column("p"), group))
        group, w, l = group[order], column("w")[order], np.nan_to_num(column("l")[order])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.cumsum(w) - w
        before -= np.repeat(before[first], np.diff(np.r_[first, len(w)]))
        sums = [np.add.reduceat(v, first) for v in (l * (2 * before + w), w, l)]
        keys = rows.select(list(by)).take(pa.array(order[first])).combine_chunks().columns
        yield pa.RecordBatch.from_arrays([*[k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys], pa.array(np.full(len(first), TaskContext.get().partitionId(), dtype=np.int32)), *map(pa.array, sums)], names)

    ranked = own.repartitionByRange(parts, *by, F.col("p").desc(), *ties).mapInArrow(rank, ", ".join([*[f"`{c}` {types[c]}" for c in by], "part int, s double, w double, l double"]))
    before = F.coalesce(F.sum("w").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a group has a row for each range
    return _gini(ranked.withColumn("before", before).groupBy(*by).agg(F.sum(F.col("s") + 2 * F.col("before") * F.col("l")).alias("s"), F.sum("w").alias("tw"), F.sum("l").alias("tl")), by)


def _gini(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    return sums.select(*by, F.try_divide(F.col("s") - F.col("tw") * F.col("tl"), F.col("tw") * F.col("tl")).alias("gini"))


def gini_at_best(df: DataFrame, actual: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, gini by the descending actual value itself. The order of equal values doesn't matter, so it is made from a row for each value."""
    own = df.select(*by, F.col(actual).cast("double").alias("a"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    values = own.groupBy(*by, "a").agg(F.sum("w").alias("w"))
    run = global_prefix_sum(values, "a", ["w"], descending=True, by=by).withColumn("l", F.col("a") * F.col("w"))
    return _gini(run.groupBy(*by).agg(F.sum(F.col("l") * (2 * F.col("before_w") + F.col("w"))).alias("s"), F.sum("w").alias("tw"), F.sum("l").alias("tl")), by)


def gini_normalized(df: DataFrame, actual: str, predicted: str, weight: str | None = None, tie: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    a = lorenz_gini(df, actual, predicted, weight, tie, by).withColumnRenamed("gini", "a")
    b = gini_at_best(df, actual, weight, by).withColumnRenamed("gini", "b")
    return (a.join(b, list(by)) if by else a.crossJoin(b)).select(*by, F.try_divide("a", "b").alias("gini"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return global_prefix_sum(counts, "score", ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score (threshold), tpr, fpr: one row for each score."""
    run = _by_score(df, label, score)
    totals = df.agg(F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("tn"))
    return run.crossJoin(F.broadcast(totals)).select("score", F.try_divide(F.col("before_pos") + F.col("pos"), F.col("tp")).alias("tpr"), F.try_divide(F.col("before_neg") + F.col("neg"), F.col("tn")).alias("fpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc, ties counted half."""
    run = _by_score(df, label, score)
    s = run.agg(F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2)).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.try_divide("s", F.col("p") * F.col("n")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """average_precision: precision at each score, weighted by the recall that it adds."""
    run = _by_score(df, label, score)
    hit = F.col("before_pos") + F.col("pos")
    s = run.agg(F.sum(F.col("pos") * hit / (hit + F.col("before_neg") + F.col("neg"))).alias("s"), F.sum("pos").alias("p"))
    return s.select(F.try_divide("s", "p").alias("average_precision"))


def calibration_table(df: DataFrame, label: str, score: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n, mean score, observed rate for equal-width bins of the score."""
    b: Column = F.least(F.greatest(F.floor((F.col(score) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(1)), F.lit(bins))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))


def cumulative(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows by descending value with the running sum, equal values by name."""
    run = global_prefix_sum(df.select(name, value), value, [value], descending=True, tie=[name])
    return run.select(name, value, (F.col(f"before_{value}") + F.col(value)).alias("cumulative"))


def top_features(df: DataFrame, name: str, value: str, share: float) -> DataFrame:
    """The fewest features, by descending value, whose values sum to the share or more."""
    return cumulative(df, name, value).where(F.col("cumulative") - F.col(value) < share)

"""Imputation, encoding, scaling and splitting. Constants are fitted on one table and applied to any; nothing is collected
but one row of constants by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix


def fit_fill(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """One row of constants: the columns' mean, exact median or (smallest) most frequent value."""
    if method == "mean":
        return df.agg(*[F.avg(c).cast("double").alias(c) for c in columns])
    held = prefix.long_form(df, columns)
    found = prefix.percentiles(held, "value", [0.5], ["name"]).select("name", F.col("p")[0].alias("v")) if method == "median" else prefix.most_frequent(held, "value", ["name"]).select("name", F.col("mode").alias("v"))
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns])


def fill_from(df: DataFrame, constants: DataFrame) -> DataFrame:
    """df with nulls filled from a one-row table of constants, column by column."""
    own = [c for c in constants.columns if c in df.columns]
    held = df.crossJoin(F.broadcast(constants.select(*[F.col(c).alias(f"__{c}") for c in own])))
    return held.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in own}).drop(*[f"__{c}" for c in own])


def fill_missing(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Filled by column; a column without any value gets the mean (or median) of the row's others."""
    filled = fill_from(df, fit_fill(df, columns, method))
    row = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(row, F.lit(0.0), lambda a, x: a + x), F.size(row))
    s, n = F.array_sort(row), F.size(row)
    half = F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return filled.withColumn("__row", half if method == "median" else mean).withColumns({c: F.coalesce(c, "__row") for c in columns}).drop("__row")


def scale_standard(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None, mean_only: bool = False) -> DataFrame:
    """(x - mean) / population standard deviation; a deviation of 0 counts as 1."""
    fit = df if fit is None else fit
    one = fit.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    held = df.crossJoin(F.broadcast(one))
    by = lambda c: F.lit(1.0) if mean_only else F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return held.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / by(c) for c in columns}).drop(*one.columns)


def scale_minmax(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column is divided by its maximum, or by 1 if that is 0."""
    fit = df if fit is None else fit
    one = fit.agg(*[x for c in columns for x in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}"))])
    held = df.crossJoin(F.broadcast(one))

    def by(c: str) -> Column:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        return F.when(a != b, b - a).when(b != 0, b).otherwise(1)

    return held.withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / by(c) for c in columns}).drop(*one.columns)


def scale_l2_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.withColumn("__n", norm).withColumns({c: F.when(F.col("__n") == 0, 0.0).otherwise(F.col(c) / F.col("__n")) for c in columns}).drop("__n")


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """A 0/1 column for each value; the values come from the table that the encoder was fitted on."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def f_test(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """column_name, f: r^2 / (1 - r^2) * (n - 2), from one pass."""
    one = df.agg(F.count(target).alias("__n"), *[F.corr(c, target).alias(c) for c in columns])
    rows = one.select("__n", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in columns])))
    r2 = F.col("r") * F.col("r")
    return rows.select("column_name", F.try_divide(r2 * (F.col("__n") - 2), 1 - r2).alias("f"))


#: Multiplier of the repeatable pseudo-random order of keys (Knuth's). Fixed value.
KNUTH = 2654435761


def shuffled(key: str, seed: int = 0) -> Column:
    """A repeatable pseudo-random number of an integer key, 0 to 2^32 - 1."""
    return F.pmod(F.col(key).cast("long") * F.lit(KNUTH) + F.lit(seed), F.lit(4294967296))


def _placed(df: DataFrame, key: str, by: Sequence[str], order: Column, totals: bool = False) -> DataFrame:
    """df with before___one: the row's place (0 for the first) in its group by a pseudo-random order, and total___one."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = df.withColumn("__order", order).withColumn("__one", F.lit(1).cast("long"))
    cuts = [4294967296 * i // parts for i in range(1, parts)]  # the order's numbers are even
    return prefix.global_prefix_sum(held, "__order", ["__one"], tie=[key], cuts=cuts, by=by, totals=totals)


def split_stratified(df: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with is_train: of each class exactly round(n * share) rows, in pseudo-random order."""
    held = _placed(df, key, [label], shuffled(key, seed), totals=True)
    return held.withColumn("is_train", F.col("before___one") < F.round(F.col("total___one") * share)).select(*df.columns, "is_train")


def split_copies(copies: DataFrame, item: str, label: str, share: float) -> DataFrame:
    """copies with is_train: split by item and stratified by the items' labels, so that all (augmented) copies of an item are on one side."""
    items = copies.groupBy(item).agg(F.min(label).alias(label))
    return copies.join(split_stratified(items, label, item, share).select(item, "is_train"), item)


def cv_kfold(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(shuffled(key, seed), F.lit(k)).cast("int"))


def cv_stratified_kfold(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Folds with the classes' shares, by place within the class."""
    held = _placed(df, key, [label], shuffled(key, seed))
    return held.withColumn("fold", F.pmod("before___one", F.lit(k)).cast("int")).select(*df.columns, "fold")


def cv_stratified_shuffle(df: DataFrame, label: str, key: str, share: float, seeds: Sequence[int]) -> DataFrame:
    """split, is_train for each seed: repeated stratified splits of the same rows, one frame."""
    each = df.withColumn("split", F.explode(F.array(*map(F.lit, seeds))))
    h = F.pmod(F.col(key).cast("long") * F.lit(KNUTH) + F.col("split"), F.lit(4294967296))
    held = _placed(each, key, ["split", label], h, totals=True)
    return held.withColumn("is_train", F.col("before___one") < F.round(F.col("total___one") * share)).select(*each.columns, "is_train")


def cv_by_group(df: DataFrame, column: str, groups: Sequence[Sequence]) -> DataFrame:
    """One copy of the rows for each group of values: fold, is_train (the group's rows train, all others test)."""
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*map(F.lit, g)).alias("g")) for i, g in enumerate(groups)])
    return df.select("*", F.inline(folds)).withColumn("is_train", F.coalesce(F.array_contains("g", F.col(column)), F.lit(False))).drop("g")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable sample: rows whose pseudo-random number is below the fraction."""
    return df.where(shuffled(key, seed) < fraction * 4294967296)

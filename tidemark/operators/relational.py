"""Projections, filters, joins, set operations and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension is broadcast by hand only below this many rows, counted first.
BROADCAST_ROWS = 100_000
#: The same for a dimension of two numbers, which takes about 40 bytes a row.
NARROW_ROWS = 2_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else as it is, and Spark picks the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def filter_conj_eq(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows where every named column has its value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()], F.lit(True)))


def with_mask(df: DataFrame, values: Mapping[str, object], name: str = "mask") -> DataFrame:
    mask = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()], F.lit(True))
    return df.withColumn(name, F.coalesce(mask, F.lit(False)))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, bool]:
    """(rows, whether the target is there): a table without it is a test table."""
    return df, target in df.columns


def replace_sentinel(df: DataFrame, columns: Sequence[str], sentinel: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def code_by_dict(df: DataFrame, column: str, codes: Mapping[str, float], out: str, default=None) -> DataFrame:
    """A number for each value by a fixed table; unknown values get the default."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default)))


def cast_columns(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """Casts the listed columns that exist."""
    return df.withColumns({c: F.col(c).cast(kind) for c in columns if c in df.columns})


def pairwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each two columns their product and their sum."""
    new = {}
    for i, a in enumerate(columns):
        for b in columns[:i]:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            new[f"{a}_p_{b}"] = F.col(a) + F.col(b)
    return df.withColumns(new)


def inf_to_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite values become the mean of the column's finite ones."""
    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in columns}
    means = df.agg(*[F.avg(finite[c]).alias(f"__{c}") for c in columns])
    held = df.crossJoin(F.broadcast(means))  # one row
    return held.withColumns({c: F.when(F.abs(F.col(c)) == float("inf"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def label_concat(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat_ws("", *[F.col(c).cast("string") for c in columns]))


def label_split(df: DataFrame, column: str, place: int, out: str) -> DataFrame:
    """The digit at a place (from 0) of a label string."""
    return df.withColumn(out, F.substring(F.col(column), place + 1, 1).cast("int"))


def join_star(facts: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """Left joins of dimensions, each on the column it is named by; a column that is already there is not taken again."""
    for key, dim in dimensions.items():
        new = [c for c in dim.columns if c not in facts.columns]
        facts = facts.join(small(dim.select(key, *new)), key, "left")
    return facts


def join_new_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that takes from the right only the columns which the left lacks."""
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")


def semi_or(facts: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of which any of the columns has a value that occurs in keys; one marker join for each column, so no nested loops."""
    marks = []
    for c in columns:
        mark = f"__in_{c}"
        facts = facts.join(keys.select(c).where(F.col(c).isNotNull()).distinct().withColumn(mark, F.lit(True)), c, "left")
        marks.append(mark)
    return facts.where(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in marks])).drop(*marks)


def unseen_share(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Values of test that train lacks, with their rows and share of all test rows."""
    total = test.agg(F.count("*").alias("total"))
    lost = test.join(train.select(column).distinct(), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))
    return lost.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def join_default(ids: DataFrame, scores: DataFrame, key: str, score: str, default: float = 0.0) -> DataFrame:
    return ids.select(key).join(scores.select(key, score), key, "left").withColumn(score, F.coalesce(F.col(score), F.lit(default)))


def mark_same(facts: DataFrame, asked: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Facts with, for each column, whether it equals that of the row of asked with the same key."""
    other = asked.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    held = facts.join(other, key)
    return held.withColumns({f"same_{c}": (F.col(c) == F.col(f"__{c}")).cast("int") for c in columns}).drop(*[f"__{c}" for c in columns])


def windows_before(facts: DataFrame, asked: DataFrame, key: str, day: str, until: str, value: Column, spans: Sequence[int]) -> DataFrame:
    """Per key, count and sum of value over facts in [until - span, until], for all spans in one pass."""
    held = facts.join(asked.select(key, until), key).withColumn("__ago", F.datediff(until, day))
    aggs = []
    for s in spans:
        inside = F.col("__ago").between(0, s)
        aggs += [F.count(F.when(inside, 1)).alias(f"n_{s}"), F.coalesce(F.sum(F.when(inside, value)), F.lit(0.0)).alias(f"sum_{s}")]
    return held.groupBy(key).agg(*aggs)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int | Column) -> DataFrame:
    """The first n rows of each group; n may be a column."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def every_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(n)) == 0)


def argmax_class(df: DataFrame, probabilities: Sequence[str], out: str) -> DataFrame:
    """Place (from 0) of the largest of several columns; ties: the first."""
    p = F.array(*map(F.col, probabilities))
    return df.withColumn(out, F.array_position(p, F.array_max(p)).cast("int") - 1)


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    """Whether all rows of a occur in b."""
    return a.join(b.distinct(), a.columns, "left_anti").limit(1).count() == 0


def product_of_uniques(df: DataFrame, columns: Sequence[str], most: int = 1_000_000) -> DataFrame:
    """Row counts of all combinations of the columns' values, those without rows too. The number of combinations is the
    product of the numbers of values; it is checked against most before anything is built."""
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    if reduce(lambda a, b: a * b, sizes, 1) > most:
        raise ValueError(f"{sizes} values give more than {most} combinations")
    grid = reduce(lambda a, b: a.crossJoin(b), [df.select(c).where(F.col(c).isNotNull()).distinct() for c in columns])
    return grid.join(df.groupBy(*columns).agg(F.count("*").alias("n")), list(columns), "left").withColumn("n", F.coalesce("n", F.lit(0)))

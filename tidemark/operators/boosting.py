"""Boosted regression trees on binned columns, of any number of rows and trees.

Trees split between bins only, so rows whose columns all fall in the same bins (a cell) always get the same answer. A round is one pass, in which tasks sum the
negative gradients of a share of their rows by cell, for all losses at once; the tree is then grown from the cells, whose number doesn't depend on
the rows. Rows are packed once, in chunks of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk; cells at most; tasks' sums that the driver adds up itself.
CHUNK, CELLS, FAN = 1 << 17, 1 << 20, 16
#: Negative gradients by label less answer, as Spark ML's GBTRegressor has them.
GRADIENTS = {"squared": lambda e: 2 * e, "absolute": lambda e: np.where(e < 0, -1.0, 1.0)}


def cuts(df: DataFrame, column: str, bins: int) -> np.ndarray:
    """The values that end a bin, without the last: all distinct ones, or quantiles where there are more."""
    found = [r[0] for r in df.select(F.col(column).cast("double").alias("v")).where("v is not null").distinct().limit(bins + 1).collect()]
    if len(found) > bins:
        found = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / bins for i in range(1, bins + 1)], 10_000)).first()[0]
    return np.array(sorted(set(found))[:-1], dtype=float)


def grown(n: np.ndarray, s: np.ndarray, places: np.ndarray, sizes: Sequence[int], depth: int) -> np.ndarray:
    """Each cell's answer by a tree for gradients with sums s of n rows; places: bins by column and cell."""
    out = np.empty(len(n))

    def grow(cells: np.ndarray, left: int) -> None:
        own, total = n[cells], s[cells]
        rows, whole = own.sum(), total.sum()
        best = (1e-12 * max(1.0, abs(whole)), None)
        for f in range(len(sizes)) if left else ():
            a, b = (np.cumsum(np.bincount(places[f][cells], v, sizes[f]))[:-1] for v in (own, total))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((a > 0) & (rows - a > 0), b * b / a + (whole - b) ** 2 / (rows - a), -np.inf) - whole * whole / max(rows, 1)
            if len(gain) and gain.max() > best[0]:
                best = gain.max(), (f, int(gain.argmax()))
        if best[1] is None:
            out[cells] = whole / rows if rows else 0.0
            return
        low = places[best[1][0]][cells] <= best[1][1]
        grow(cells[low], left - 1)
        grow(cells[~low], left - 1)

    grow(np.arange(len(n)), depth)
    return out


def _taken(ids: np.ndarray, k: int, share: float) -> np.ndarray:
    """Whether a round takes these rows: by a hash of id and round."""
    z = ids + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


@dataclass
class Boosted:
    """Answers by cell for each loss."""

    features: Sequence[str]
    ends: list[np.ndarray]
    answers: dict[str, np.ndarray]

    def cells(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        found = np.zeros(len(columns[0]), dtype=np.int64)
        for x, ends in zip(columns, self.ends, strict=True):
            found = found * (len(ends) + 1) + np.searchsorted(ends, x)
        return found

    def predict(self, df: DataFrame, loss: str, out: str = "prediction") -> DataFrame:
        cells, answers = self.cells, self.answers[loss]

        @F.arrow_udf("double")
        def answer(*columns: pa.Array) -> pa.Array:
            return pa.array(answers[cells([c.to_numpy(zero_copy_only=False) for c in columns])])

        return df.withColumn(out, answer(*[F.col(c).cast("double") for c in self.features]))


def boost(df: DataFrame, key: str, features: Sequence[str], label: str, losses: Sequence[str] = ("squared", "absolute"), trees: int = 1000, rate: float = 0.1, share: float = 0.9, depth: int = 3, bins: int = 32) -> Boosted:
    """A tree for the label, then trees for the losses' negative gradients, each times the rate, on a share of the rows that a hash of the key (whole
    numbers) draws anew for each tree. Columns have no nulls."""
    found = Boosted(features, [cuts(df, c, bins) for c in features], {})
    sizes = [len(e) + 1 for e in found.ends]
    k = int(np.prod(sizes, dtype=float))
    if k > CELLS:
        raise ValueError(f"{k} cells of {len(features)} columns; at most {CELLS}, so fewer bins or columns")
    places = np.stack(np.unravel_index(np.arange(k), sizes))
    place = found.cells

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: list) -> pa.RecordBatch:
            y, ids, *columns = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            values = (y.astype(float), ids.astype(np.int64), place(columns).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["y", "ids", "cell"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield whole(held)
                held, n = [], 0
        if n:
            yield whole(held)

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(key).cast("long").alias("ids"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    packed = rows.mapInArrow(pack, "y binary, ids binary, cell binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)  # a round of an RDD needs no plan
    parts = packed.getNumPartitions()
    answers = {c: np.zeros(k) for c in losses}
    try:
        for t in range(trees):

            def make(chunks, t=t, answers=dict(answers)):
                total = np.zeros((1 + len(losses), k))
                for y, ids, cell in chunks:
                    y, ids, cell = np.frombuffer(y), np.frombuffer(ids, dtype=np.uint64), np.frombuffer(cell, dtype=np.int32)
                    if share < 1:
                        took = _taken(ids, t, share)
                        y, cell = y[took], cell[took]
                    total[0] += np.bincount(cell, minlength=k)
                    for i, c in enumerate(losses):
                        total[1 + i] += np.bincount(cell, GRADIENTS[c](y - answers[c][cell]) if t else y, k)
                yield total

            made = packed.mapPartitions(make)
            sums = sum(made.collect()) if parts <= FAN else made.treeReduce(np.add)
            for i, c in enumerate(losses):
                answers[c] = answers[c] + (rate if t else 1.0) * grown(sums[0], sums[1 + i], places, sizes, depth)
    finally:
        packed.unpersist()
    found.answers.update(answers)
    return found

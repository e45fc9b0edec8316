"""Exact nearest neighbours of any number of rows, by an index that is dealt over tasks.

Rows of train belong to the cell of their nearest pivot; a cell is cut into rings by the distance r to the pivot, a crowded ring into slices
by hash. A query first asks the rings around its own place, which bounds how far its k-th neighbour can be; with that bound the triangle
inequality tells which rings of which cells can hold a nearer row (|d(q, pivot) - r| is at most d(q, row)), and only those are asked. Around its own
place a query goes to slices, where distances to a few reference points rule out most rows before any distance is computed. For the rest, blocks of queries
meet blocks of rows without an exchange of either by the other: a block of queries passes all blocks of a task's rows and keeps the k nearest so far, which
narrows its bounds. So what is written and exchanged grows with the rows, not with their pairs; a task holds one block of each.

Ties in distance go to the smaller key of train. With fewer than k rows all of them are neighbours. Rows with a null feature are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from .relational import small

#: Rows of a slice, about; and reference points.
SLICE, REFERENCES = 1024, 8
#: Pairs of a query and a cell that a task has at once.
VISITS = 1 << 14
#: Rows of a block of queries and of train; blocks of train that a task has at once; pairs whose distances are computed at once.
ASKING, BLOCK, BLOCKS, PAIRS = 1 << 12, 1 << 14, 4, 1 << 21
#: Bounds are widened by this share, so that rounding loses no neighbour.
SLACK = 1e-9


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _points(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


@dataclass(frozen=True)
class Cells:
    """What tasks know of the index: a row for each pivot, whose number is bounded."""

    pivots: np.ndarray
    n: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @property
    def rings(self) -> np.ndarray:
        return np.maximum(1, -(-self.n // SLICE))

    def ring(self, cell: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The ring of a distance, from 0; distances outside the cell's fall into the first or last."""
        width = (self.most - self.least)[cell] / self.rings[cell]
        found = np.floor(np.divide(r - self.least[cell], width, out=np.zeros(len(cell)), where=width > 0))
        return np.clip(found, 0, self.rings[cell] - 1).astype(np.int64)

    def reach(self, far: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query, given its distances to the pivots, surely has k rows."""
        upper = far + self.most
        upper[:, self.n == 0] = np.inf
        order = np.argsort(upper, axis=1)
        enough = (np.cumsum(self.n[order], axis=1) >= k).argmax(axis=1)
        found = np.take_along_axis(upper, order, 1)[np.arange(len(far)), enough]
        return np.where(self.n.sum() >= k, found, np.inf)

    def visits(self, far: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """query, cell, first ring, last ring: where rows within reach can be. A row is nearer to its own pivot than to others, so it is at
        least half as far as its pivot is farther than the query's nearest one."""
        with np.errstate(invalid="ignore"):
            lower = np.maximum(np.maximum(far - self.most, self.least - far), (far - far.min(axis=1, keepdims=True)) / 2)
        q, c = np.nonzero((lower <= reach[:, None]) & (self.n > 0))
        d, t = far[q, c], np.minimum(reach[q], 1e300)
        yield from zip(q.tolist(), c.tolist(), self.ring(c, d - t).tolist(), self.ring(c, d + t).tolist(), strict=True)


def _as_points(df: DataFrame, features: Sequence[str], *more: str) -> DataFrame:
    return df.select(*more, F.transform(F.array(*[F.col(f).cast("double") for f in features]), lambda x: F.coalesce(x, F.raise_error(F.lit("a feature is null")).cast("double"))).alias("v"))


def index(train: DataFrame, key: str, features: Sequence[str], keep: Sequence[str] = (), most_pivots: int = 512) -> tuple[DataFrame, DataFrame, Cells]:
    """(rows: other, keep, v, refs, cell, r, ring, slice; rings: cell, ring, slices; cells). About as many pivots as the root of
    train's rows, at most most_pivots: the rows with the smallest hashes of their keys."""
    held = _as_points(train.withColumn("other", F.col(key)), features, "other", *keep)
    n = held.count()
    chosen = held.orderBy(F.xxhash64("other"), "other").limit(max(1, min(most_pivots, math.isqrt(n)))).select("v").toPandas()
    pivots = np.unique(_points(chosen["v"]).reshape(-1, len(features)), axis=0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)

    def place(batches):
        for pdf in batches:
            far = _far(_points(pdf["v"]).reshape(-1, pivots.shape[1]), pivots)
            cell = far.argmin(axis=1)
            yield pdf.assign(refs=list(far[:, :REFERENCES]), cell=cell, r=far[np.arange(len(cell)), cell])

    placed = kept(held.mapInPandas(place, f"{schema}, refs array<double>, cell long, r double"), "cells")
    stats = {row["cell"]: row for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()}  # a row for each pivot
    column = lambda name: np.array([float(stats[c][name]) if c in stats else 0.0 for c in range(len(pivots))])
    cells = Cells(pivots, column("n").astype(np.int64), column("least"), column("most"))

    def ring(cell: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(cells.ring(cell.to_numpy(), r.to_numpy()))

    rows = placed.withColumn("ring", F.pandas_udf(ring, "long")("cell", "r"))
    rings = kept(rows.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (2 * SLICE)).alias("slices")), "rings")
    dealt = rows.join(small(rings), ["cell", "ring"]).withColumn("slice", F.pmod(F.xxhash64("other"), "slices")).drop("slices")
    return kept(dealt, "index"), rings, cells


def _ask(made: DataFrame, visits: DataFrame, key: str, k: int, keep: Sequence[str], skip_own: bool) -> DataFrame:
    """key, other, keep, far, computed (distances, in the first row of each slice that was asked): the k nearest rows of each slice. visits:
    key, v, refs, cell, at (distance to the cell's pivot), reach, ring, slice."""
    spark = made.sparkSession
    types = {f.name: f.dataType.simpleString() for f in (*made.schema.fields, *visits.schema.fields)}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = made.select("cell", "ring", "slice", F.lit(0).alias("guest"), "other", *keep, F.lit(None).cast(types[key]).alias("asks"), "v", "refs", F.col("r").alias("at"), F.lit(0.0).alias("reach"))
    two = visits.select("cell", "ring", "slice", F.lit(1).alias("guest"), F.lit(None).cast(types["other"]).alias("other"), *[F.lit(None).cast(types[c]).alias(c) for c in keep], F.col(key).alias("asks"), "v", "refs", "at", "reach")
    both = one.unionByName(two).repartition(parts, "cell", "ring", "slice").sortWithinPartitions("cell", "ring", "slice", "guest", "other")
    names = [key, "other", *keep, "far", "computed"]

    def run(batches):
        held, at = [], None
        for pdf in batches:
            for place, own in pdf.groupby(["cell", "ring", "slice"], sort=False):
                if place != at:
                    held, at, block = [], place, None
                rows, asks = own[own["guest"] == 0], own[own["guest"] == 1]
                if len(rows):
                    held.append(rows)
                if not len(asks) or not held:
                    continue
                if block is None:  # rows come before those that ask
                    whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                    block = whole, _points(whole["v"]), _points(whole["refs"]), whole["at"].to_numpy()
                    held = [whole]
                out = _answers(block, asks, k, skip_own)
                if out:
                    nearest = block[0].iloc[np.concatenate([i for _, i, _, _ in out])]
                    yield pd.DataFrame({key: np.repeat(np.array([q for q, *_ in out], dtype=object), [len(i) for _, i, _, _ in out]), "other": nearest["other"].to_numpy(), **{c: nearest[c].to_numpy() for c in keep}, "far": np.concatenate([d for _, _, d, _ in out]), "computed": np.concatenate([[n, *[0] * (len(i) - 1)] for _, i, _, n in out])})[names]

    return both.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in [key, "other", *keep]) + ", far double, computed long")


def _answers(block: tuple, asks: pd.DataFrame, k: int, skip_own: bool) -> list[tuple]:
    """(query, places in the block, distances, number of distances computed) of the queries that have any."""
    rows, points, refs, at = block
    others, out = rows["other"].to_numpy(), []
    for q, v, r, d, reach in zip(asks["asks"], asks["v"], asks["refs"], asks["at"], asks["reach"], strict=True):
        near = np.flatnonzero(np.abs(at - d) <= reach)
        near = near[(np.abs(refs[near] - r) <= reach).all(axis=1)]
        if skip_own:
            near = near[others[near] != q]
        if len(near):
            far = np.sqrt(((points[near] - v) ** 2).sum(axis=1))
            best = np.argsort(far, kind="stable")[:k]  # rows come by key
            out.append((q, near[best], far[best], len(near)))
    return out


def _visits(batches: Iterator[pd.DataFrame], cells: Cells, key: str, k: int, own: bool) -> Iterator[pd.DataFrame]:
    """Which rings the queries ask. own: those around the query's place; else the others within reach. A query can ask rings of all cells, and each
    row has its point, so only a few queries are taken at once."""
    step = max(1, VISITS // max(1, len(cells.pivots)))
    for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
        far = _far(_points(pdf["v"]).reshape(-1, cells.pivots.shape[1]), cells.pivots)
        home = far.argmin(axis=1)
        place = cells.ring(home, far[np.arange(len(far)), home])
        reach = cells.reach(far, k)
        if not own:
            reach = np.minimum(reach, pdf["reach"].fillna(np.inf).to_numpy())
        reach = reach * (1 + SLACK) + SLACK
        if own:
            rows = [(q, c, max(0, p - 1), p + 1) for q, (c, p) in enumerate(zip(home.tolist(), place.tolist(), strict=True))]
        else:
            rows = []
            for q, c, a, b in cells.visits(far, reach):
                if c != home[q]:
                    rows.append((q, c, a, b))
                else:  # without the rings around its place
                    rows += [(q, c, x, y) for x, y in ((a, min(b, place[q] - 2)), (max(a, place[q] + 2), b)) if x <= y]
        if rows:
            q, c, a, b = (np.array(x) for x in zip(*rows, strict=True))
            yield pd.DataFrame({key: pdf[key].to_numpy()[q], "v": pdf["v"].to_numpy()[q], "refs": list(far[q][:, :REFERENCES]), "cell": c, "at": far[q, c], "reach": reach[q], "first": a, "last": b})


def _cut(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        for at in range(0, len(pdf), size):
            held.append(pdf.iloc[at : at + size])
            n += len(held[-1])
            if n >= size:
                whole = pd.concat(held, ignore_index=True)
                yield whole.iloc[:size]
                held, n = [whole.iloc[size:]], n - size
    if n:
        yield pd.concat(held, ignore_index=True)


def _doubles(column: pd.Series) -> bytes:
    return np.ascontiguousarray(_points(column)).tobytes()


class _Asking:
    """A block of queries that passes blocks of train."""

    def __init__(self, keys: np.ndarray, points: np.ndarray, reach: np.ndarray, cells: Cells, k: int, skip_own: bool):
        self.keys, self.points, self.cells, self.k, self.skip_own = keys, points, cells, k, skip_own
        self.far = _far(points, cells.pivots)
        self.home = self.far.argmin(axis=1)
        self.place = cells.ring(self.home, self.far[np.arange(len(keys)), self.home])
        self.least = self.far.min(axis=1)
        self.reach = np.minimum(cells.reach(self.far, k + skip_own), reach) * (1 + SLACK) + SLACK
        self.squares = (points * points).sum(axis=1)
        self.held: list[tuple] = []
        self.computed = 0

    def meet(self, cell: np.ndarray, ring: np.ndarray, points: np.ndarray, others: np.ndarray, keep: list[np.ndarray]) -> None:
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1])])
        squares = (points * points).sum(axis=1)
        for a, b in zip(first, np.r_[first[1:], len(cell)], strict=True):
            c, g, f = cell[a], ring[a], self.far[:, cell[a]]
            lower = np.maximum(np.maximum(f - self.cells.most[c], self.cells.least[c] - f), (f - self.least) / 2)
            here, far = np.full(len(f), c), np.minimum(self.reach, 1e300)
            asks = (lower <= self.reach) & (self.cells.ring(here, f - far) <= g) & (g <= self.cells.ring(here, f + far))
            asks = np.flatnonzero(asks & ~((self.home == c) & (np.abs(self.place - g) <= 1)))  # those around its place were asked before
            step = max(1, PAIRS // (b - a))
            for q in (asks[at : at + step] for at in range(0, len(asks), step)):
                self._nearer(q, slice(a, b), points, squares, others, keep)
        self._narrow()

    def _nearer(self, q: np.ndarray, rows: slice, points: np.ndarray, squares: np.ndarray, others: np.ndarray, keep: list[np.ndarray]) -> None:
        """Squares of all distances by a product, which tells whose distances are worth computing to the last digit."""
        own = points[rows]
        loose = 1e-11 * (self.squares[q] + squares[rows].max())
        about = self.squares[q][:, None] + squares[rows] - 2 * self.points[q] @ own.T
        self.computed += about.size
        top = self.reach[q] ** 2
        k = self.k + self.skip_own
        if k < len(own):
            top = np.minimum(top, np.partition(about, k - 1, axis=1)[:, k - 1] + loose)
        i, j = np.nonzero(about <= (top + loose)[:, None])
        for at in range(0, len(i), PAIRS // 32):
            x, y = q[i[at : at + PAIRS // 32]], j[at : at + PAIRS // 32]
            far = np.sqrt(((own[y] - self.points[x]) ** 2).sum(axis=1))
            found = far <= self.reach[x]
            if self.skip_own:
                found &= others[rows][y] != self.keys[x]
            if found.any():
                self.held.append((x[found], far[found], others[rows][y[found]], *[v[rows][y[found]] for v in keep]))

    def _narrow(self) -> None:
        """The k nearest so far; a query that has so many looks no further."""
        if not self.held:
            return
        q, far, other, *keep = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((other, far, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        best = order[place < self.k]
        self.held = [(q[place < self.k], far[best], other[best], *[v[best] for v in keep])]
        last = place == self.k - 1
        self.reach[q[last]] = np.minimum(self.reach[q[last]], far[order[last]] * (1 + SLACK) + SLACK)


def _meet(made: DataFrame, asked: DataFrame, cells: Cells, key: str, k: int, keep: Sequence[str], skip_own: bool) -> DataFrame:
    """key, other, keep, far, computed (in the first row of a block of queries): the k nearest rows, of those that are not around a query's own place,
    of each group of blocks. asked: key, v, reach."""
    types = {f.name: f.dataType.simpleString() for f in (*made.schema.fields, *asked.schema.fields)}
    parts, width = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.pivots.shape[1]
    names = [key, "other", *keep, "far", "computed"]

    def pack_asked(batches):
        for n, pdf in enumerate(_cut(batches, ASKING)):
            yield pd.DataFrame({"block": [f"{TaskContext.get().partitionId()}-{n}"], "keys": [pdf[key].to_numpy()], "points": [_doubles(pdf["v"])], "reach": [pdf["reach"].fillna(np.inf).to_numpy(float).tobytes()]})

    def pack_rows(batches):
        for pdf in _cut(batches, BLOCK):
            yield pd.DataFrame({"cell": [pdf["cell"].to_numpy(np.int64).tobytes()], "ring": [pdf["ring"].to_numpy(np.int64).tobytes()], "rows": [_doubles(pdf["v"])], "others": [pdf["other"].to_numpy()], **{f"k{i}": [pdf[c].to_numpy()] for i, c in enumerate(keep)}})

    queries = kept(asked.select(key, "v", "reach").mapInPandas(pack_asked, f"block string, keys array<{types[key]}>, points binary, reach binary"), "asking")
    rows = made.select("cell", "ring", "v", "other", *keep).repartition(max(1, -(-int(cells.n.sum()) // BLOCK)), "cell", "ring").sortWithinPartitions("cell", "ring")
    blocks = kept(rows.mapInPandas(pack_rows, f"cell binary, ring binary, rows binary, others array<{types['other']}>" + "".join(f", k{i} array<{types[c]}>" for i, c in enumerate(keep))), "blocks")
    both = queries.repartition(parts).hint("shuffle_replicate_nl").crossJoin(blocks.repartition(max(1, -(-blocks.count() // BLOCKS))))

    def run(batches):
        at, state = None, None

        def found() -> Iterator[pd.DataFrame]:
            if state is not None and state.held:
                q, far, other, *kinds = state.held[0]
                yield pd.DataFrame({key: state.keys[q], "other": other, **dict(zip(keep, kinds, strict=True)), "far": far, "computed": np.r_[state.computed, np.zeros(len(q) - 1)].astype(np.int64)})[names]

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.block != at:
                    yield from found()
                    at, state = r.block, _Asking(np.asarray(r.keys), np.frombuffer(r.points).reshape(-1, width), np.frombuffer(r.reach), cells, k, skip_own)
                state.meet(np.frombuffer(r.cell, dtype=np.int64), np.frombuffer(r.ring, dtype=np.int64), np.frombuffer(r.rows).reshape(-1, width), np.asarray(r.others), [np.asarray(getattr(r, f"k{i}")) for i in range(len(keep))])
        yield from found()

    return both.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in [key, "other", *keep]) + ", far double, computed long")


def candidates(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], k: int, keep: Sequence[str] = (), skip_own: bool = False, most_pivots: int = 512) -> DataFrame:
    """key, other, keep, far, computed: rows of train among which are each query's k nearest. skip_own: a row isn't its own neighbour."""
    made, rings, cells = index(train, key, features, keep, most_pivots)
    kind = test.schema[key].dataType.simpleString()
    asked = _as_points(test, features, key)
    wide = k + 1 if skip_own else k
    schema = f"`{key}` {kind}, v array<double>, refs array<double>, cell long, at double, reach double, first long, last long"

    def to_slices(visits: DataFrame) -> DataFrame:
        each = visits.withColumn("ring", F.explode(F.sequence("first", "last"))).drop("first", "last").join(small(rings), ["cell", "ring"])
        return each.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

    first = kept(_ask(made, to_slices(asked.mapInPandas(lambda b: _visits(b, cells, key, wide, True), schema)), key, k, keep, skip_own), "near")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("far", "other"))
    bound = first.select(key, "far", nth.alias("nth")).where(F.col("nth") == k).select(F.col(key).alias("__key"), F.col("far").alias("reach"))
    again = asked.join(bound, F.col(key) == F.col("__key"), "left").select(key, "v", "reach")
    return first.unionByName(_meet(made, again, cells, key, k, keep, skip_own))


def nearest(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], k: int, keep: Sequence[str] = (), skip_own: bool = False, most_pivots: int = 512) -> DataFrame:
    """key, place (from 1), other (train's key), far, keep: the k nearest rows of train of each row of test."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("far", "other"))
    return candidates(train, test, key, features, k, keep, skip_own, most_pivots).withColumn("place", nth).where(F.col("place") <= k).select(key, "place", "other", "far", *keep)


def knn(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], label: str, k: int, by_distance: bool = False, skip_own: bool = False) -> DataFrame:
    """key, prediction: vote of the k nearest rows, each with weight 1 or 1 / distance; ties: the smallest label."""
    weight = 1 / (F.col("far") + 1e-12) if by_distance else F.lit(1.0)
    votes = nearest(train, test, key, features, k, [label], skip_own).groupBy(key, label).agg(F.sum(weight).alias("w"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("label")))["label"].alias("prediction"))

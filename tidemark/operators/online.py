"""A linear model with pinball loss over hashed features, learned online within tasks.

Numbers and words of texts share one space of 2 ** bits weights by the hash of their names, so features need no dictionary. Rows are packed once, in
chunks of arrays. In a round every task's learners go over their rows in small batches with steps that adapt to each weight (to the root of the mean of its
squared slopes), from the weights that all start with; the learners' weights are averaged by their rows. A round's starting weights are scored in the same pass, and the best of them are kept;
where a round doesn't better them, the next one takes half the step. Rounds end when steps are below the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense import summed


def place(name: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(name) & ((1 << bits) - 1)


def _columns(numbers: Sequence[str], words: Sequence[str], bits: int) -> list[Column]:
    """The numbers, and for each text an array of its words' places (lower case)."""

    def of_text(c: str) -> Column:
        own = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(own, lambda w: F.xxhash64(F.lit(c), w).bitwiseAND(F.lit((1 << bits) - 1)))

    return [*[F.col(c).cast("double") for c in numbers], *map(of_text, words)]


def _parts(arrays: Sequence[pa.Array], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of a batch of _columns(): the numbers (null: NaN) as rows, and for each text the words of each row, all places, and their values: how often
    a word occurs as a share of the root of the number of words."""
    found = [c.to_numpy(zero_copy_only=False).astype(float) for c in arrays[:n]]
    texts = []
    for c in arrays[n:]:
        many = np.diff(c.offsets.to_numpy()).astype(np.int64)
        texts.append((many, c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(1 / np.sqrt(np.maximum(many, 1)), many)))
    return np.stack(found, axis=1) if found else np.empty((len(arrays[0]) if arrays else 0, 0)), texts


@dataclass
class Chunk:
    """Rows as one run of values: those of row k are from edge[k] to edge[k + 1]. A value's place is at[key]."""

    y: np.ndarray
    edge: np.ndarray
    at: np.ndarray
    key: np.ndarray
    x: np.ndarray

    SCHEMA = "y binary, edge binary, at binary, key binary, x binary"
    KINDS = (np.float64, np.int32, np.int64, np.int32, np.float64)

    @classmethod
    def of(cls, y: np.ndarray, numbers: np.ndarray, texts: list, places: np.ndarray, size: int) -> Chunk:
        """places: of the constant and the numbers. Nulls are left out."""
        fixed = np.c_[np.ones(len(y)), numbers]
        there = ~np.isnan(fixed)
        n = there.sum(axis=1)
        edge = np.r_[0, np.cumsum(n + sum((many for many, _, _ in texts), np.zeros(len(y), dtype=np.int64)))]
        i, x = np.empty(edge[-1], dtype=np.int64), np.empty(edge[-1])
        own = (edge[:-1, None] + np.cumsum(there, axis=1) - 1)[there]
        i[own], x[own] = np.broadcast_to(places, there.shape)[there], fixed[there]
        begin = edge[:-1] + n
        for many, place, value in texts:
            own = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(place))
            i[own], x[own] = place, value
            begin = begin + many
        seen = np.zeros(size, dtype=bool)
        seen[i] = True
        return cls(y, edge, np.flatnonzero(seen), (np.cumsum(seen) - 1)[i], x)

    def packed(self) -> list[bytes]:
        return [np.asarray(v, dtype=kind).tobytes() for v, kind in zip((self.y, self.edge, self.at, self.key, self.x), self.KINDS, strict=True)]

    @classmethod
    def unpacked(cls, values: Sequence[bytes]) -> Chunk:
        return cls(*[np.frombuffer(v, dtype=kind) for v, kind in zip(values, cls.KINDS, strict=True)])


#: Rows of a chunk, and the fewest of them that a learner has. Learners of a task take batches in turn, all at once in NumPy; WEIGHTS bounds what they hold.
CHUNK, ALONE, WEIGHTS = 1 << 17, 4096, 1 << 21


def _chunks(rows: DataFrame, numbers: Sequence[str], words: Sequence[str], bits: int) -> DataFrame:
    """A row for each chunk of a task's rows; rows: the label, and _columns()."""
    places = np.array([place(c, bits) for c in ("", *numbers)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            made = Chunk.of(table.column(0).to_numpy(zero_copy_only=False), *_parts(table.columns[1:], len(numbers)), places, 1 << bits)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in made.packed()], ["y", "edge", "at", "key", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield whole()
                held, n = [], 0
        if held:
            yield whole()

    return rows.mapInArrow(pack, Chunk.SCHEMA)


class Learners:
    """What a task goes through in a round: learners that all start with the weights w, each with batches of its own."""

    def __init__(self, n: int, w: np.ndarray, tau: float, step: float, usual: np.ndarray | None, batch: int):
        self.w, self.tau, self.step, self.usual, self.batch, self.n = w, tau, step, usual, batch, n
        self.own, self.moved, self.sums = np.tile(w, (n, 1)), np.zeros((n, len(w))), np.zeros((n, len(w)))
        self.t, self.seen, self.loss = np.zeros(n), np.zeros(n), 0.0

    def learn(self, c: Chunk) -> None:
        a, tau, rows = c.at, self.tau, len(c.y)
        error = c.y - np.add.reduceat(self.w[a][c.key] * c.x, c.edge[:-1])
        self.loss += np.maximum(tau * error, (tau - 1) * error).sum()
        own, moved, sums = (v[:, a].ravel() for v in (self.own, self.moved, self.sums))
        usual = None if self.usual is None else np.tile(self.usual[a], self.n)
        many, whole = np.diff(c.edge), self.batch * self.n
        learner = np.arange(whole) // self.batch
        for k in range(0, rows, whole):
            rows_of = slice(k, min(k + whole, rows))
            first, last = c.edge[k], c.edge[rows_of.stop]
            who = learner[: rows_of.stop - k]
            taken = np.bincount(who, minlength=self.n)
            x, n = c.x[first:last], many[rows_of]
            key = c.key[first:last] + np.repeat(who * len(a), n)
            e = c.y[rows_of] - np.add.reduceat(own[key] * x, c.edge[rows_of] - first)
            slope = np.where(e > 0, -tau, np.where(e < 0, 1 - tau, 0.0)) / taken[who]
            slope = np.repeat(slope, n) * x
            if len(own) <= 4 * len(x):  # the weights of all learners, or those that occur
                at, g, t = slice(None), np.bincount(key, slope, len(own)), np.repeat(self.t, len(a))
            else:
                at, back = np.unique(key, return_inverse=True)
                g, t = np.bincount(back, slope), self.t[at // len(a)]
            sums[at] += g * g
            change = -self.step * g / np.maximum(np.sqrt(sums[at]) if usual is None else usual[at] * np.sqrt(1 + t), 1e-12)
            own[at] += change
            moved[at] += t * change
            self.t += taken > 0
            self.seen += taken
        for held, new in ((self.own, own), (self.moved, moved), (self.sums, sums)):
            held[:, a] = new.reshape(self.n, -1)

    def result(self) -> np.ndarray:
        """Loss of w, rows, batches; by rows, the mean over all weights that a learner went through; squares of slopes."""
        mean = self.own - self.moved / np.maximum(self.t, 1)[:, None]
        return np.concatenate([[self.loss, self.seen.sum(), self.t.sum()], self.seen @ mean, self.sums.sum(axis=0)])


@dataclass
class Quantile:
    """The fitted model."""

    weights: np.ndarray
    bits: int
    numbers: Sequence[str]
    words: Sequence[str]
    loss: float

    def weight(self, name: str = "") -> float:
        """Of a number, or the constant."""
        return float(self.weights[place(name, self.bits)])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        weights, n = self.weights, len(self.numbers)
        own = weights[[place(c, self.bits) for c in self.numbers]] if n else np.empty(0)
        first = self.weight()

        @F.arrow_udf("double")
        def answer(rows: pa.Array, *arrays: pa.Array) -> pa.Array:
            numbers, texts = _parts(arrays, n)
            found = np.full(len(rows), first)
            if n:
                found += np.nan_to_num(numbers) @ own
            for many, at, value in texts:
                found += np.bincount(np.repeat(np.arange(len(rows)), many), weights[at] * value, len(rows))
            return pa.array(found)

        return df.withColumn(out, answer(F.lit(0), *_columns(self.numbers, self.words, self.bits)))


def fit_quantile(df: DataFrame, label: str, numbers: Sequence[str], tau: float, words: Sequence[str] = (), bits: int = 18, rounds: int = 200, rate: float = 0.5, tolerance: float = 1e-3, batch: int = 16) -> Quantile:
    """Weights of least pinball loss at the quantile tau. Numbers should be of like size. Rows without a label are left out."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[c.alias(f"c{i}") for i, c in enumerate(_columns(numbers, words, bits))])
    start = rows.agg(F.percentile_approx("y", tau, 1000), F.stddev_pop("y")).first()
    if start[0] is None:
        raise ValueError("no labels")
    size, spread = 1 << bits, float(start[1] or 1.0)
    w = np.zeros(size)
    w[place("", bits)] = start[0]
    step, best, kept = rate, np.inf, w
    held = _chunks(rows, numbers, words, bits).persist()

    def one(w: np.ndarray, step: float, usual: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of w, the next weights, and each weight's usual slope (root of the mean square). Steps are in terms of the last round's
        usual slopes; the first round has those of its own batches so far."""

        def make(batches):
            found = None
            for pdf in batches:
                for values in pdf.itertuples(index=False):
                    chunk = Chunk.unpacked(values)
                    if found is None:
                        found = Learners(max(1, min(len(chunk.y) // ALONE, WEIGHTS // size)), w, tau, step * spread, usual, batch)
                    found.learn(chunk)
            return np.zeros(3 + 2 * size) if found is None else found.result()

        got = summed(held, make)
        return got[0] / got[1], got[3 : 3 + size] / got[1], np.sqrt(got[3 + size :] / got[2])

    usual = None
    try:
        for _ in range(rounds):
            loss, new, usual = one(w, step, usual)
            step = step if loss < best * (1 - 3e-4) else step / 2
            if loss < best:
                best, kept = loss, w
            if step < rate * tolerance:
                break
            w = new
    finally:
        held.unpersist()
    return Quantile(kept, bits, tuple(numbers), tuple(words), float(best))

"""Quality rules and a classifier of hashed n-grams.

Counts that rules use are exact, over whole texts. The classifier is a logistic regression on hashed word 1- and
2-grams and hashed character 3-grams (of code points), fitted by Spark on labelled rows, calibrated by Platt's method on
a quarter of them that the calibrated model wasn't fitted on, then fitted again on all, and used in Arrow batches with fixed
thresholds.

Training takes at most `bound` labelled documents (those with the smallest hash of their id, whatever the input's size). Their
features stay in tasks, a written table; what comes to the driver is weights (DIMS doubles) and one margin for each document held
out. Null text: empty; it has no words and fails the base rules. Repeated rows and null ids are judged each by itself; of
labelled rows with equal ids the greatest label and the smallest text count. A probability equal to the threshold is kept. Without
labelled rows of both classes every text that passes the base rules is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, mixed, pieces, texts, written

BITS = 15
DIMS = 1 << BITS
#: Reject below this calibrated probability of good quality.
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = b"#*$%&|<>"


def repeated_windows(ids: np.ndarray, n: int = 8) -> int:
    """Words in windows of n (a power of two) that are found twice or more, the first one included; exact, by doubling."""
    rank, span = ids, 1
    while span < n:
        if len(rank) <= span:
            return 0
        key = rank[:-span] * np.int64(len(ids) + 1) + rank[span:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at blanks and \\t\\n\\v\\f\\r, nothing else
    n = len(words)
    if not n:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0
    word_chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c")))
    lines = [x for x in data.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n) if n >= 9 else np.empty(0, np.int64)
    repeats = repeated_windows(ids) if len(number) < n and n >= 9 else 0
    return n, word_chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed dimensions and values: square roots of the counts, of length one."""
    words = text.encode("utf-8", "surrogatepass").split()
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    chars = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    pairs = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
    h = np.concatenate([mixed(w), mixed(pairs ^ np.uint64(1 << 40)), (chars * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)])
    n = np.bincount((h & np.uint64(DIMS - 1)).view(np.int64), minlength=DIMS)
    at = np.flatnonzero(n)
    value = np.sqrt(n[at])
    return at, value / max(np.sqrt((value * value).sum()), 1e-9)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    iterations: int = 0

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[at] @ value) + self.bias

    def probability(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(*features(text)) + self.shift, -40, 40))))


def _platt(margin: np.ndarray, y: np.ndarray, even: bool = False) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins of rows that weren't trained on; even: the rarer class weighs
    more, half way to the weight of the other."""
    good, n = y.sum(), len(y)
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
    weight = np.sqrt(np.where(y > 0, n / max(good, 1), n / max(n - good, 1))) if even else np.ones(n)
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(n)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(h, x.T @ (weight * (p - target)))
        a, b = a - da, b - db
    return float(a), float(b)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, positive: int | None = None) -> DataFrame:
    """doc_id, text and label of at most bound documents, those with the smallest hash of doc_id; with positive: at most so many
    with a label above 0, and the rest of bound of the others."""
    own = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    first = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    own = first(own, bound) if positive is None else first(own.where("label > 0"), positive).union(first(own.where("label <= 0"), bound - positive))
    return texts(docs).join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").cast("double").alias("label"))


def _fitted(rows: DataFrame, l2: float = 1e-5, tolerance: float = 1e-4, steps: int = 1000):
    """Logistic regression by gradients summed in tasks, until an iteration lowers the loss by less than its part `tolerance`; a fit
    that takes more than `steps` is an error. Both classes have the same weight in all. None without both classes."""
    from pyspark.ml.classification import LogisticRegression  # the workers that score need not load it

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    weighted = rows.withColumn("weight", F.when(F.col("label") > 0, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]))
    model = LogisticRegression(labelCol="label", weightCol="weight", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=steps, tol=tolerance).fit(weighted)
    if model.summary.totalIterations >= steps:
        raise ValueError(f"the fit has not come to its tolerance in {steps} iterations")
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000, slices: int = 6) -> Model | None:
    """A model from labelled rows; null if they don't have both classes. slices: tasks of a gradient (the table is bounded)."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors, VectorUDT

    vector = F.udf(lambda at, value: Vectors.sparse(DIMS, at, value), VectorUDT())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["doc_id", "label", "at", "value"])

    own = labelled(docs, labels, "quality", bound).select("doc_id", "text", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"))
    kind = own.schema["doc_id"].dataType.simpleString()
    held = written(own.mapInArrow(run, f"doc_id {kind}, label double, at array<int>, value array<double>"), "quality-features")
    rows = held.select("label", vector("at", "value").alias("features"), (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("held")).coalesce(slices).persist()
    try:
        whole, first = _fitted(rows), _fitted(rows.where("not held"))
        if whole is None:
            return None
        model = Model(whole.coefficients.toArray(), float(whole.intercept), iterations=whole.summary.totalIterations)
        if first is not None:
            shown = first.transform(rows.where("held")).select("label", vector_to_array("rawPrediction")[1].alias("margin")).collect()
            y, margin = (np.array([r[c] for r in shown], dtype=float) for c in ("label", "margin"))
            if len(set(y)) == 2:
                slope, shift = _platt(margin, y)
                if slope > 0:
                    model.slope, model.shift = slope, shift
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, *more: str) -> DataFrame:
    """doc_id, the five counts, base_failed, probability, kept, and the columns named in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = counts(text)
                failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEATED_PERCENT * found[0]
                p = model.probability(text) if model else 1.0
                rows.append((*found, failed, p, not failed and p >= threshold))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    source = bounded(docs).select("doc_id", *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ["doc_id", *more])
    return source.mapInArrow(run, schema + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, bound: int = 4000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that rules and classifier keep. Null ids and repeated rows are judged each by itself."""
    model = train(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            good = []
            for text in batch.column("text").to_pylist():
                found = counts(text or "")
                failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEATED_PERCENT * found[0]
                good.append(not failed and (model is None or model.probability(text or "") >= threshold))
            yield batch.filter(pa.array(good, pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)

"""Toxicity from the nearest labelled examples.

A bounded sample of labelled rows (of each class those with the smallest hash of their id) gives the examples: TF-IDF vectors over all terms that
they have (words, and word beginnings of four and five bytes). A term's IDF is raised by what the label says of it: a cautious
logarithm of how much more often toxic examples have it than others (0 for most terms), so that a few telling words weigh as much
as the subject of a text. Examples are kept as an inverted index with, for each term and block of examples, the largest weight. A
text's nearest examples by cosine are exact: blocks are taken by the bound that these weights give, until no other block can hold
a nearer one. The vote is weighted by nearness; its calibration (Platt) is made with each example scored by the others.

Null or empty text, and text with none of the terms, has no neighbours: its vote is 0. Only the text is used for a score. Of equally
near examples those with smaller ids count. Repeated rows, repeated and null ids are scored each row by itself; of labelled rows with
equal ids the greatest label and the smallest text count. An id of null is not held out. The index goes to all tasks; its size is
bounded by `bound` and the examples' distinct terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts
from .quality import _platt, labelled

BLOCK = 64
NEIGHBOURS = 15
#: A weak pull of the vote towards 0, as of a neighbour with this nearness.
CALM = 0.25
#: What the IDF of a term counts that toxic examples have no more often than others.
BASE = 0.5
_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> Counter:
    """Words of a text with counts, and their beginnings, which count once."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    out = Counter(words)
    for w in list(out):
        if len(w) >= 6:
            out[b"^" + w[:4]] = out[b"^" + w[:5]] = 1
    return out


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one range after another, and how many each has."""
    n = end - begin
    upto = np.cumsum(n)
    return np.repeat(begin - upto + n, n) + np.arange(int(upto[-1]) if len(n) else 0, dtype=begin.dtype), n


class Index:
    """Examples by term, with the largest weight in each block of examples that a term occurs in."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray):
        self.vocabulary, self.idf, self.labels, self.ids = vocabulary, idf, labels, ids
        self.blocks = max(1, -(-len(rows) // BLOCK))
        term = np.concatenate([t for t, _ in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
        row = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        order = np.lexsort((row, term))
        self.row, self.weight = row[order].astype(np.int32), weight[order].astype(np.float32)
        cell = term[order] * self.blocks + self.row // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        #: Cells are blocks that have a term, in order of terms: postings begin[c] to begin[c + 1], the largest weight, the block.
        self.begin = np.append(begin, len(cell)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.empty(0)
        self.block = (cell[begin] % self.blocks).astype(np.int32)
        self.of_term = np.searchsorted(cell[begin] // self.blocks, np.arange(len(vocabulary) + 1)).astype(np.int32)
        self.slope, self.shift = 1.0, 0.0

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        own = [(self.vocabulary[t], n) for t, n in found.items() if t in self.vocabulary]
        if not own:
            return np.empty(0, np.int64), np.empty(0)
        t = np.array([x for x, _ in own])
        w = (1 + np.log([n for _, n in own])) * self.idf[t]
        return t, w / math.sqrt(w @ w)

    def nearest(self, t: np.ndarray, w: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest (ties: the smaller place), fewer if fewer have a term in common."""
        if not len(t):
            return np.empty(0, np.int64), np.empty(0)
        cells, n = ranges(self.of_term[t], self.of_term[t + 1])
        block, weight = self.block[cells], np.repeat(w, n)
        most = np.bincount(block, weight * self.most[cells], self.blocks)
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        score, taken = np.zeros(self.blocks * BLOCK), np.zeros(self.blocks, dtype=bool)
        done, step, kth = 0, 8, 0.0
        while done < len(order) and most[order[done]] >= kth - 1e-12:
            taken[:] = False
            taken[order[done : done + step]] = True
            now = np.flatnonzero(taken[block])
            at, n = ranges(self.begin[cells[now]], self.begin[cells[now] + 1])
            score += np.bincount(self.row[at], np.repeat(weight[now], n) * self.weight[at], len(score))
            done, step = done + step, step * 4
            if without >= 0:
                score[without] = 0
            kth = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        best = np.flatnonzero(score >= max(kth, 1e-12))
        best = best[np.lexsort((best, -score[best]))][:k]
        return best, score[best]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine * self.labels[near]).sum() / (cosine.sum() + CALM)) if len(near) else 0.0

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        votes = np.array([self.vote(*self.nearest(t, w, i)) for i, (t, w) in enumerate(rows)])
        slope, shift = _platt(votes, self.labels.astype(float), even=True)
        if slope > 0:
            self.slope, self.shift = slope, shift

    def score(self, text: str) -> tuple[float, np.ndarray]:
        near, cosine = self.nearest(*self.vector(terms(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.vote(near, cosine) + self.shift)))), near


def train(docs: DataFrame, labels: DataFrame, bound: int = 1200, toxic: int = 240) -> Index | None:
    """An index of at most bound examples, at most `toxic` of them toxic; labels: doc_id, toxic. Null without rows of both classes."""
    rows = labelled(docs, labels, "toxic", bound, toxic).select(F.col("doc_id").cast("long"), "text", (F.col("label") > 0).cast("int").alias("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            found = [terms(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["doc_id", "label", "term", "n"])

    got = rows.mapInArrow(counted, "doc_id long, label int, term array<binary>, n array<int>").toArrow().combine_chunks().sort_by("doc_id")
    label = got["label"].to_numpy()
    n, bad = len(label), int(label.sum())
    if not 0 < bad < n:
        return None
    column, counts = got["term"].combine_chunks(), got["n"].combine_chunks().flatten().to_numpy()
    size = np.diff(column.offsets.to_numpy())
    coded = column.flatten().dictionary_encode()
    names, term = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), size)
    df, bad_df = np.bincount(term, minlength=len(names)), np.bincount(term, label[row], len(names))
    # the least that toxic counts may stand for, against the others'
    odds = np.log((np.maximum(bad_df - 1.5 * np.sqrt(bad_df), 0) + 0.1) / (df - bad_df + 0.5) * ((n - bad) / bad))
    idf = (np.log((n + 1) / (df + 1)) + 1) * (BASE + np.maximum(odds, 0))
    weight = (1 + np.log(counts)) * idf[term]
    weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row]
    edge = np.concatenate([[0], np.cumsum(size)])
    examples = [(term[a:b], weight[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
    index = Index({t: i for i, t in enumerate(names)}, idf, examples, label, got["doc_id"].to_numpy())
    index.calibrate(examples)
    return index


def score(docs: DataFrame, index: Index | None, evidence: int = 3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5), evidence: ids of the nearest examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [index.score(t) if index else (0.0, []) for t in batch.column("text").to_pylist()]
            values = [s for s, _ in found]
            near = [index.ids[n[:evidence]] if index else [] for _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64()), pa.array([int(s >= 0.5) for s in values], pa.int32()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence array<long>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))

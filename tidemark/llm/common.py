"""Helpers that several text operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: with texts of some KB a batch has some MB, in the JVM and in Python.
BATCH_ROWS = 1000


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches held at BATCH_ROWS rows."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table carries is left out."""
    return bounded(docs).select("doc_id", *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def unused(columns: list[str], name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two rows have one id. Ids alone are counted; texts aren't read."""
    return docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def sha256(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share. One machine that has none set, as in tests, takes a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


class Tables(list):
    """Paths of the tables that written() makes while this is open, in this thread. Runs side by side have lists of their own."""

    def __enter__(self) -> Tables:
        self.token = _tables.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _tables.reset(self.token)

    def clear_but_last(self, spark: SparkSession) -> None:
        """Deletes all of them but the last one."""
        for path in self[:-1]:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
        del self[:-1]


_tables: ContextVar[Tables | None] = ContextVar("tables", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage and survives lost executors. It stays, but within Tables."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (tables := _tables.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A value for each byte, and the base of the polynomial whose values over a word's bytes are its hash. Both pseudo-random.
BYTES = np.array([xxhash.xxh3_64_intdigest(f"byte {i}") for i in range(256)], dtype=np.uint64)
BASE = xxhash.xxh3_64_intdigest("base") | 5
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: So many powers of BASE and of its inverse are kept; longer data are rare and have theirs made anew.
POWERS = 1 << 20


def _made(n: int) -> list[np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        own = np.full(n, base, dtype=np.uint64)
        own[0] = 1
        out.append(np.multiply.accumulate(own))
    return out


_kept = functools.cache(lambda: _made(POWERS))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes, none of them 0, of the spans [start, end) of values, wherever they stand: polynomials by prefix sums."""
    power, inverse = _kept() if len(values) <= POWERS else _made(len(values))
    upto = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values + values.dtype.type(1)) * power[: len(values)], out=upto[1:])
    h = mixed((upto[end] - upto[start]) * inverse[start])
    h[h == 0] = 1
    return h


def word_hashes(texts: list[str], lower: bool = False, most_bytes: int = 1 << 18) -> Iterator[np.ndarray]:
    """64-bit hashes of the words (runs without blanks and \\t\\n\\v\\f\\r) of each text; lower: A-Z count as a-z."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        data = data.lower() if lower else data  # of bytes: A-Z only
        if len(data) > 2 * most_bytes:
            yield from _word_hashes(group)
            group, size = [], 0
            yield np.concatenate([next(_word_hashes([part])) for part in _cut_at_blanks(data, most_bytes)])
            continue
        group.append(data)
        size += len(data) + 1
        if size >= most_bytes:
            yield from _word_hashes(group)
            group, size = [], 0
    yield from _word_hashes(group)


def _cut_at_blanks(data: bytes, step: int) -> Iterator[bytes]:
    """Long data in parts of about a step; no word is cut."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + step)
        to = found.end() if found else len(data)
        yield data[at:to]
        at = to


def _word_hashes(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    data = np.frombuffer(b"\n".join([b"", *group, b""]), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(BLANK[data].view(np.int8))) + 1
    start, end = edge[::2], edge[1::2]
    words = span_hashes(BYTES[data], start, end)
    ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
    done = 0
    for k in np.searchsorted(start, ends).tolist():
        yield words[done:k]
        done = k


#: Odd multipliers, one for each place of an n-gram.
PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (the finalizer of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words; none if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m] * PLACES[0]
    for j in range(1, n):
        h = h + words[j : m + j] * PLACES[j]
    return mixed(h + np.uint64(n))


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column text holds about most_bytes in each, whatever the length of the rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def with_totals(rows: DataFrame, by: list[str], spread: Column, **totals: tuple[str, Column]) -> DataFrame:
    """The rows (with by, which is never null) and their group's totals: name = ("sum" or "min", what).

    A group may hold any share of the rows: it is cut by the column spread, each cut is summed before the exchange, and the totals go back
    to the cuts and from these to the rows, so that no task gets a whole group. rows are read twice; give a table."""
    cut, merge = unused(rows.columns, "cut"), {"sum": F.sum, "min": F.min}
    rows = rows.withColumn(cut, F.pmod(F.xxhash64(spread), F.lit(partitions(rows.sparkSession))))
    parts = rows.groupBy(*by, cut).agg(*[merge[how](what).alias(name) for name, (how, what) in totals.items()])
    whole = parts.groupBy(*by).agg(*[merge[how](name).alias(name) for name, (how, _) in totals.items()])
    return rows.join(parts.select(*by, cut).join(whole, by), [*by, cut]).drop(cut)

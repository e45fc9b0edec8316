"""The main aggregations as Structured Streaming jobs: chunks arrive as files, totals are kept as state.

State and checkpoints are in the shared folder, so a job goes on where it was when an executor or the driver is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.recast import VIEWS, _needs, view
from ..sources.io import fresh, kept


def stream(spark: SparkSession, sf_dir: str, table: str, files_at_once: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{sf_dir}/{table}.parquet*")


def view_of_stream(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    """A view with one of its tables streamed and the others static."""
    return spark.sql(VIEWS[name], **{n: stream(spark, sf_dir, n) if n == table else view(spark, sf_dir, n) for n in _needs(VIEWS[name])})


def run_all(df: DataFrame, mode: str, each: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None) -> list[dict]:
    """Runs a stream over all that is there, then ends; gives the batches' progress. With the checkpoint of an earlier run it goes on from there."""
    query = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or fresh(df.sparkSession, f"stream-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def to_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Appends a batch's rows under its number, so that a batch that runs again replaces what it wrote."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def to_table(df: DataFrame, name: str) -> DataFrame:
    """All rows of an appending stream."""
    path = fresh(df.sparkSession, name)
    run_all(df, "append", to_batches(path), name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Totals:
    """Totals by key of a stream that are kept as partial sums: a batch writes one row for each key that it has, under its number, and
    readers add up. So a batch's work and writes depend on its own keys, no state is kept, and a batch that runs again replaces what it
    wrote. Every `every` batches the sums so far are merged in a thread of their own; what was merged is left out on reading, and a batch that is
    run again after it was merged is left out, too. totals: name = SQL of what to sum, whole numbers or decimals for sums that don't depend on order."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], totals: Mapping[str, str], every: int = 16) -> None:
        self.spark, self.path, self.keys, self.totals, self.every = spark, path, list(keys), dict(totals), every
        self.background, self.pending = ThreadPoolExecutor(1), None

    def _numbers(self, kind: str) -> list[int]:
        """Of the batches or merges that are there whole."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in store.listStatus(top)] if store.exists(top) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def add(self, batch: DataFrame, number: int) -> None:
        if any(number <= n for n in self._numbers("merged")):
            return
        sums = batch.groupBy(*self.keys).agg(*[F.expr(f"sum({c})").alias(n) for n, c in self.totals.items()])
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        if (number + 1) % self.every == 0:
            self.settle()
            self.pending = self.background.submit(self.merge, number)

    def merge(self, upto: int) -> None:
        self._read(upto).write.mode("overwrite").parquet(f"{self.path}/merged/upto={upto}")

    def settle(self) -> None:
        """Waits for the merge that runs, and raises what it raised."""
        if self.pending is not None:
            self.pending.result()

    def _read(self, upto: int | None = None) -> DataFrame | None:
        done = max(self._numbers("merged"), default=-1)
        parts = [f"{self.path}/batches/batch={n}" for n in self._numbers("batches") if n > done and (upto is None or n <= upto)]
        parts += [f"{self.path}/merged/upto={done}"] if done >= 0 else []
        return self.spark.read.parquet(*parts).groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.totals]) if parts else None

    def read(self, stream: DataFrame) -> DataFrame:
        """The totals so far; stream: what was added up, for the columns of a table without rows."""
        self.settle()
        found = self._read()
        if found is None:
            static = self.spark.createDataFrame([], stream.schema)
            return static.groupBy(*self.keys).agg(*[F.expr(f"sum({c})").alias(n) for n, c in self.totals.items()])
        return found


OFFER_TOTALS = {"n": "1L", "price": "CASE WHEN quantity > 0 THEN amount / quantity ELSE 0 END", "quantity": "quantity", "returns": "CASE WHEN quantity <= 0 THEN 1L ELSE 0L END"}


def offer_stats(transactions: DataFrame, every: int = 16) -> DataFrame:
    """Totals by category, company and brand of all that the stream has; ratios are made when they are read."""
    spark = transactions.sparkSession
    kept = Totals(spark, fresh(spark, "offer-stats"), ["category", "company", "brand"], OFFER_TOTALS, every)
    run_all(transactions, "append", kept.add, "offer-stats")
    return kept.read(transactions)


def in_chunks(rows: DataFrame, order: str, chunks: int, name: str) -> str:
    """A folder to which the rows are written in so many chunks by ascending order, one after another, as a stream would bring them."""
    spark = rows.sparkSession
    path = fresh(spark, name)
    rows = kept(rows, name)  # what makes the rows, joins perhaps, runs once and not for each chunk
    cuts = rows.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 1000).alias("c")).first()["c"] if chunks > 1 else []
    cuts = sorted(set(cuts or []))
    for k in range(len(cuts) + 1):
        inside = [F.col(order) > cuts[k - 1]] if k else []
        inside += [F.col(order) <= cuts[k]] if k < len(cuts) else []
        reduce(lambda df, c: df.where(c), inside, rows).write.parquet(f"{path}/chunk={k}")
    return path


def ended(rows: DataFrame, key: str, place: Column, delay: int, *features: str) -> DataFrame:
    """key and features of every key, once, when its rows have ended: place (a whole number that rises with the stream, such as a shopper's
    number in a file that is sorted by it) has gone on by more than delay since the key's last row. Then its state goes. Rows that come
    later than that are dropped and counted by Spark (numRowsDroppedByWatermark). Sessions do what timers would, in the JVM."""
    timed = rows.withColumn("__at", F.timestamp_seconds(place))
    made = timed.withWatermark("__at", f"{delay} seconds").groupBy(F.session_window("__at", "1 second"), key).agg(*map(F.expr, features), F.count(key).alias("__rows"))
    return made.where("__rows > 0").drop("session_window", "__rows")  # a filter on the key would keep marks from the watermark


SHOPPER_FEATURES = ("count(*) AS n", "sum(amount) AS total", "max(date) AS last")


def shopper_state(spark: SparkSession, folder: str, schema: StructType, delay: int, path: str | None = None, checkpoint: str | None = None, close: bool = True) -> tuple[DataFrame, list[dict]]:
    """(id, n, total and last of the shoppers whose rows have ended; progress of the batches) of transactions that come to a folder's
    chunks sorted by shopper, but for up to delay shoppers. With close, no more rows come: marks beyond all ids are added, and the stream goes on
    from its checkpoint, so that the shoppers still open end. With the path and checkpoint of an earlier run it goes on from there."""
    path, checkpoint = path or fresh(spark, "shoppers"), checkpoint or fresh(spark, "stream-shoppers")
    marks = f"{checkpoint}-marks"
    kind = schema["id"].dataType.simpleString()
    spark.createDataFrame([], f"id {kind}, amount double, date date, mark long").write.mode("append").parquet(marks)

    def run() -> list[dict]:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).parquet(f"{folder}/chunk=*")
        rows = rows.select("id", F.col("amount").cast("double").alias("amount"), "date", F.lit(None).cast("long").alias("mark"))
        closing = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(marks)
        made = ended(rows.unionByName(closing), "id", F.coalesce("mark", "id"), delay, *SHOPPER_FEATURES)
        return run_all(made, "append", to_batches(path), "shoppers", checkpoint)

    progress = run()
    if close:
        mark = spark.createDataFrame([(None, None, None, 1 << 33)], spark.read.parquet(marks).schema).coalesce(1)
        for _ in range(2):  # one moves the watermark, the next one's batch finds what it has ended
            mark.write.mode("append").parquet(marks)
        progress += run()
    return spark.read.schema(f"id {kind}, n long, total double, last date").parquet(path).select("id", "n", "total", "last"), progress

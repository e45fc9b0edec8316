"""Registered queries of sources, sinks and streams: tables go out to the shared folder and come back."""

from __future__ import annotations

import struct

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import models
from ..sources import io
from ..streaming import streams
from .recast import as_sql, rounded, rounded_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None, columns: str = "", places: int = 9):
    names = columns.split()

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(spark, sf_dir), names, places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(as_sql(sql), names, places)
        return make

    return add


_PASSENGERS = "SELECT id, survived, pclass, sex, fare, embarked, age FROM {passengers}"
_SCHEMA = "id long, survived int, pclass int, sex string, fare double, embarked string, age long"


def _csv(spark: SparkSession, sf_dir: str, name: str, df: DataFrame | None = None) -> str:
    path = io.fresh(spark, name)
    io.write_csv(view(spark, sf_dir, "passengers") if df is None else df, path)
    return path


@register("src_csv_header", _PASSENGERS, "fare")
def src_csv_header(spark, sf_dir):
    return io.read_csv(spark, _csv(spark, sf_dir, "csv"), _SCHEMA)


@register("src_csv_typed", "SELECT id, coalesce(fare, -1) AS fare, coalesce(age, -1) AS age, sex, CAST(-1 AS DOUBLE) AS embarked FROM {passengers}", "fare")
def src_csv_typed(spark, sf_dir):
    return io.read_csv_typed(spark, _csv(spark, sf_dir, "csv"), {"id": "long", "survived": "int", "pclass": "int", "sex": "string", "fare": "double", "embarked": "double", "age": "long"}, keep=["id", "fare", "age", "sex", "embarked"])


@register("src_csv_headerless", "SELECT id AS c0, pclass AS c1, fare AS c2 FROM {passengers}", "c2")
def src_csv_headerless(spark, sf_dir):
    path = io.fresh(spark, "csv")
    view(spark, sf_dir, "passengers").select("id", "pclass", "fare").write.csv(path, header=False, sep=" ")
    return io.read_csv(spark, path, "c0 long, c1 long, c2 double", header=False, sep=" ")


@register("src_csv_schema_sample", "SELECT id, pclass, fare FROM {passengers}", "fare")
def src_csv_schema_sample(spark, sf_dir):
    rows = io.read_csv_sampled(spark, _csv(spark, sf_dir, "csv", view(spark, sf_dir, "passengers").select("id", "pclass", "fare")))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("pclass").cast("long").alias("pclass"), "fare")


@register("src_multi_file_keyed", "SELECT sky_id % 5 AS file_id, galaxy, x, e1 FROM {skies}", "x e1")
def src_multi_file_keyed(spark, sf_dir):
    path = io.fresh(spark, "skies")
    view(spark, sf_dir, "skies").select("galaxy", "x", "e1", (F.col("sky_id") % 5).alias("Sky")).write.partitionBy("Sky").csv(path, header=True)
    return io.read_keyed_files(spark, f"{path}/*", "galaxy long, x double, e1 double", r"Sky=([0-9]+)/", "file_id")


@register("src_pickled_split", "SELECT v.vec_id, v.label, count(*) AS width, sum(e) AS total FROM {cells} v GROUP BY v.vec_id, v.label", "total")
def src_pickled_split(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings")
    both = io.read_split(rows.select("vec_id", "embedding"), rows.select("vec_id", "label"), "vec_id")
    return both.select("vec_id", "label", F.size("embedding").cast("long").alias("width"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


#: A bitmap's header for 8 by 8 pixels of 24 bits, rows from the bottom. Fixed values of the format.
_BMP = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + 192, 0, 0, 54, 40, 8, 8, 1, 24, 0, 192, 0, 0, 0, 0)


@register("src_images_labelled", "SELECT image_id, CAST(label AS VARCHAR) AS class, 8 AS height, 8 AS width, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) FILTER (r = 0 AND c = 0) AS BIGINT) AS first, CAST(max(v) FILTER (r = 7 AND c = 6) AS BIGINT) AS late, CAST((SELECT count(*) FROM {embeddings} WHERE vec_id % 50 = 0) AS BIGINT) AS skipped FROM {pixels} JOIN {embeddings} ON image_id = vec_id WHERE image_id % 50 <> 0 GROUP BY image_id, label")
def src_images_labelled(spark, sf_dir):
    """Pixels go out as bitmaps, a folder for each class, some of them broken, and are read back."""
    byte = lambda q: F.unhex(F.lpad(F.hex(q["v"].cast("int")), 2, "0"))
    one = view(spark, sf_dir, "pixels").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((7 - F.col("r")).alias("up"), "c", "v"))).alias("p"))
    body = F.aggregate("p", F.lit(b""), lambda a, q: F.concat(a, byte(q), byte(q), byte(q)))
    labels = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    content = F.when(F.col("image_id") % 50 == 0, F.encode(F.lit("no image"), "UTF-8")).otherwise(F.concat(F.lit(_BMP), body))
    files = one.join(labels, "image_id").select(F.concat_ws("/", F.col("label").cast("string"), F.concat("image_id", F.lit(".bmp"))).alias("path"), content.alias("content"))
    folder = io.fresh(spark, "images")
    io.write_files(files, folder)
    good, bad = io.read_images_labelled(spark, folder, files)
    at = lambda i: F.conv(F.hex(F.substring("data", 3 * i + 1, 1)), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a + F.conv(F.hex(F.substr("data", 3 * i + 1, F.lit(1))), 16, 10).cast("long"))
    shown = good.select(F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("long").alias("image_id"), "class", "height", "width", total.alias("total"), at(0).alias("first"), at(62).alias("late"))
    return shown.crossJoin(F.broadcast(bad.agg(F.count("*").alias("skipped"))))


@register("src_predictions_text", "SELECT id, score / 1000 AS score FROM {scores}", "score")
def src_predictions_text(spark, sf_dir):
    path = io.fresh(spark, "scores")
    view(spark, sf_dir, "scores").select(F.concat_ws(" ", F.col("score") / 1000, "id").alias("value")).write.text(path)
    return io.read_scores_text(spark, path)


@register("src_log_metrics", "SELECT shopping_pt AS epoch, avg(round(cost, 2)) AS err FROM {quotes} GROUP BY shopping_pt", "err")
def src_log_metrics(spark, sf_dir):
    path = io.fresh(spark, "log")
    line = F.format_string("epoch %d, validation error %.2f", "shopping_pt", F.round("cost", 2))
    rows = view(spark, sf_dir, "quotes")
    rows.select(line.alias("value")).union(rows.select(F.lit("other line 7"))).write.text(path)
    return io.read_log_metrics(spark, path)


@register("sink_csv", "SELECT offer, brand, offervalue FROM {offers}", "offervalue")
def sink_csv(spark, sf_dir):
    path = io.fresh(spark, "csv")
    io.write_csv(view(spark, sf_dir, "offers").select("offer", "brand", "offervalue"), path)
    return io.read_csv(spark, path, "offer long, brand string, offervalue double")


@register("sink_csv_append", "SELECT id, market FROM {history}")
def sink_csv_append(spark, sf_dir):
    path, rows = io.fresh(spark, "csv"), view(spark, sf_dir, "history").select("id", "market")
    for k in range(3):
        io.write_csv(rows.where(F.col("id") % 3 == k), path, "append")
    return io.read_csv(spark, path, "id long, market string")


@register("sink_sparse_text", "SELECT id, survived || ' ''' || id || ' |f ' || concat_ws(' ', CASE WHEN coalesce(fare, 0) <> 0 THEN 'fare:' || printf('%.4f', fare) END, CASE WHEN coalesce(age, 0) <> 0 THEN 'age:' || printf('%.4f', CAST(age AS DOUBLE)) END) AS line FROM {passengers}")
def sink_sparse_text(spark, sf_dir):
    path = io.fresh(spark, "sparse")
    view(spark, sf_dir, "passengers").select(io.sparse_line(F.col("survived"), F.col("id"), ["fare", "age"]).alias("value")).write.text(path)
    return spark.read.text(path).select(F.regexp_extract("value", "'([0-9]+)", 1).cast("long").alias("id"), F.col("value").alias("line"))


@register("sink_submission", "SELECT h.id, CAST(coalesce(round(s.score / 100), 0) AS BIGINT) AS prediction FROM {history} h LEFT JOIN {scores} s ON h.id = s.id")
def sink_submission(spark, sf_dir):
    scores = view(spark, sf_dir, "scores").select("id", (F.col("score") / 100).alias("prediction"))
    path = io.fresh(spark, "submission")
    io.write_csv(io.submission(view(spark, sf_dir, "history"), scores, "id", "prediction", whole=True), path)
    return io.read_csv(spark, path, "id long, prediction long")


@register("materialize_condensed", "SELECT customer_id, count(*) AS n_quotes FROM {quotes} WHERE record_type = 0 GROUP BY customer_id")
def materialize_condensed(spark, sf_dir):
    path = io.fresh(spark, "condensed")
    for _ in range(2):  # the second time it is read, not made
        out = io.materialized(spark, path, lambda: agg.condense_customers(view(spark, sf_dir, "quotes")))
    return out.select("customer_id", "n_quotes")


@register("stream_offer_stats", "SELECT category, company, brand, count(*) AS n, sum(CASE WHEN quantity > 0 THEN amount / quantity ELSE 0 END) AS price, sum(quantity) AS quantity, count(*) FILTER (quantity <= 0) AS returns FROM {transactions} GROUP BY ALL", "price quantity")
def stream_offer_stats(spark, sf_dir):
    return streams.offer_stats(streams.view_of_stream(spark, sf_dir, "transactions", "lineitem"))


@register("stream_shopper_state", "SELECT id, count(*) AS n, sum(amount) AS total, CAST(max(date) AS VARCHAR) AS last FROM {transactions} GROUP BY id", "total")
def stream_shopper_state(spark, sf_dir):
    """Transactions come in six chunks, sorted by shopper; a shopper's row is written once, when theirs have ended."""
    rows = view(spark, sf_dir, "transactions").select("id", "amount", "date")
    found, _ = streams.shopper_state(spark, streams.in_chunks(rows, "id", 6, "transactions"), rows.schema, delay=0)
    return found.withColumn("last", F.col("last").cast("string"))


@register("stream_block_features", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target, CAST(target > 0 AS INT) AS y FROM {loss}", "target")
def stream_block_features(spark, sf_dir):
    rows = streams.view_of_stream(spark, sf_dir, "loss", "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target", (F.col("target") > 0).cast("int").alias("y"))
    return streams.to_table(rows, "blocks").select(*rows.columns)


@register(
    "stream_score",
    "WITH m AS (SELECT avg(var10) AS a, avg(var13) AS b, avg(target) AS t FROM {loss}), s AS (SELECT sum((var10 - a) * (var10 - a)) AS aa, sum((var10 - a) * (var13 - b)) AS ab, sum((var13 - b) * (var13 - b)) AS bb, sum((var10 - a) * (target - t)) AS ta, sum((var13 - b) * (target - t)) AS tb FROM {loss}, m), c AS (SELECT (ta * bb - tb * ab) / (aa * bb - ab * ab) AS x, (tb * aa - ta * ab) / (aa * bb - ab * ab) AS y FROM s) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t + x * (var10 - a) + y * (var13 - b) AS score FROM {loss}, m, c",
    "score",
    4,
)
def stream_score(spark, sf_dir):
    """A pipeline is fitted and stored; a stream is scored chunk by chunk with what is read back."""
    path = io.fresh(spark, "stored-model")
    models.pipeline(["var10", "var13"], models.linear("target", "ordinary", 0).setSolver("normal")).fit(view(spark, sf_dir, "loss")).save(path)
    scored = PipelineModel.load(path).transform(streams.view_of_stream(spark, sf_dir, "loss", "lineitem"))
    rows = scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("prediction").alias("score"))
    return streams.to_table(rows, "scored").select(*rows.columns)

"""Typed sources and sinks. Missing values of any spelling become nulls, or a stated default, where they are read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. One machine that has none set, as in tests, takes a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and lost executors cost no more than their tasks."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file at most, where a fit holds a table in memory.
ROWS = 100_000


def spread(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, of files of about ROWS rows and at least one for each core, however few it comes from; so no task
    of a fit has to hold all of it."""
    return kept(df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))), name)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV table with an explicit schema; without a header the schema names the columns."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep)


def read_csv_typed(spark: SparkSession, path: str, fields: Mapping[str, str], default: float | None = -1, header: bool = True, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns parsed to declared types; a number that can't be read becomes the default (None: null)."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in fields)).csv(path, header=header)

    def parsed(c: str, kind: str) -> Column:
        if kind == "string":
            return F.nullif(F.col(c), F.lit("")).alias(c)
        value = F.col(c).try_cast(kind)
        if kind in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(c)

    return raw.select(*[parsed(c, k) for c, k in fields.items() if keep is None or c in keep])


def read_csv_sampled(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """Types are inferred from the first rows and hold for the whole file. They are taken in the order of tasks, of which the first begins with a
    file's header; rows of other tasks that came first would give the columns' names."""
    head = [r[0] for r in spark.read.text(path).take(rows + 1)]
    schema = spark.read.csv(spark.sparkContext.parallelize(head, 1), header=True, inferSchema=True).schema
    return spark.read.schema(schema).csv(path, header=True)


def read_keyed_files(spark: SparkSession, path: str, schema: str, pattern: str, key: str) -> DataFrame:
    """Many CSV files with headers; the entity's id is taken from the file's name."""
    rows = spark.read.schema(schema).csv(path, header=True).select("*", F.col("_metadata.file_path").alias("__f"))
    return rows.withColumn(key, F.regexp_extract("__f", pattern, 1).cast("long")).drop("__f")


def read_split(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features and labels that are kept in separate tables."""
    return features.join(labels, key)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes a file for each row of path (below the folder) and content; every task writes its own. Gives their number."""

    def run(batches):
        local = "://" not in folder or folder.startswith("file:")
        store, top = (pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_images_labelled(spark: SparkSession, path: str, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images: path, class (the parent folder), height, width, nChannels, data; skipped: path, message) of a folder's image files; with
    listed (a column path of file names as they end), of those only. Files that aren't images are skipped with a message."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    raw = raw.withColumn("path", F.col("origin"))
    if listed is not None:
        name = lambda c, n: F.array_join(F.slice(F.split(c, "/"), -n, n), "/")
        raw = raw.withColumn("__name", name("path", 2)).join(listed.select(name("path", 2).alias("__name")).distinct(), "__name", "left_semi").drop("__name")
    good = raw.where("height >= 0").select("path", F.element_at(F.split("path", "/"), -2).alias("class"), "height", "width", "nChannels", "data")
    return good, raw.where("height < 0").select("path", F.concat(F.lit("not an image: "), F.element_at(F.split("path", "/"), -1)).alias("message"))


def read_scores_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `score id`."""
    return spark.read.schema("score double, id long").csv(path, sep=" ").select("id", "score")


def read_log_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Mean error of each epoch from the lines that begin with `epoch`; numbers are found by pattern."""
    numbers = F.regexp_extract_all("value", F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    rows = spark.read.text(path).where(F.col("value").startswith("epoch")).select(F.get(numbers, F.lit(0)).cast("long").alias("epoch"), F.element_at(numbers, -1).cast("double").alias("err"))
    return rows.groupBy("epoch").agg(F.avg("err").alias("err"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def sparse_line(label: Column, key: Column, features: Sequence[str], df_types: Mapping[str, str] | None = None) -> Column:
    """`label 'id |f name:value ...` with the features that are neither null nor 0."""
    parts = F.array(*[F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.concat(F.lit(f"{c}:"), F.format_string("%.4f", F.col(c).cast("double")))) for c in features])
    return F.concat_ws(" ", F.format_string("%d", label.cast("int")), F.concat(F.lit("'"), key.cast("string")), F.lit("|f"), F.array_join(F.array_compact(parts), " "))


def submission(ids: DataFrame, predictions: DataFrame, key: str, column: str, whole: bool = False) -> DataFrame:
    """Every id with its prediction, 0 where there is none; whole: rounded to an integer."""
    out = ids.select(key).join(predictions.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    return out.withColumn(column, F.round(column).cast("long")) if whole else out


def materialized(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path if it is there whole, else what make() gives, written there first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_if_better(model, score: float, path: str, spark: SparkSession, higher: bool = True) -> float:
    """Writes a fitted pipeline and its score if it beats the stored one; gives the score that is stored afterwards."""
    table = f"{path}/score"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    old = spark.read.parquet(table).first()["score"] if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None
    if old is not None and (old >= score if higher else old <= score):
        return old
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(float(score),)], "score double").write.mode("overwrite").parquet(table)
    return score

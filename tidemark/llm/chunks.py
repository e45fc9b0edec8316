"""Exact dedup by content-defined chunk recipes, in JVM expressions.

A text without its blanks (space, \\t, \\n, \\v, \\f, \\r) is cut where its content says so: after LEAST characters behind the first three characters
of the classes in EDGE, or at MOST characters. Equal stretches of different texts so have equal chunks, wherever they stand. A chunk
is moved once, to find out that its identifier (an MD5 under a seed) stands for no other chunk; two chunks under one identifier mean
another seed. From then on a text is its recipe, the ordered list of identifiers, and texts are equal if and only if their recipes are.

A null text counts as empty, and all empty texts are equal. Each row is a document of its own, also where ids are null or repeat; of equal
texts stays the row with the most code points before blanks are deleted, then that with the smallest doc_id (null: last), then any one of the
rows that agree in both. Other columns of the table are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256, texts, unused, with_totals, written

#: Characters of a chunk at least and at most.
LEAST, MOST = 256, 4096


def _class(first: int) -> str:
    """A class of every eighth code point of Latin-1 that is a letter or digit, and of every eighth run of 64 beyond, which is
    looked at for characters beyond only."""
    near = "".join(chr(c) for c in range(0x21 + first, 0x100, 8) if chr(c).isalnum())
    far = "".join(f"\\x{{{c:X}}}-\\x{{{c + 63:X}}}" for c in range(0x100 + 64 * first, 0xD800, 512))
    return f"[{near}[\\x{{100}}-\\x{{D7FF}}&&[{far}]]]"


EDGE = _class(0) + _class(3) + _class(5)
CHUNK = f"(?s).{{{LEAST - 3},{MOST - 3}}}?{EDGE}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def cut(text: Column) -> Column:
    """The chunks of a text, in order; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def md5_of(chunk: Column, seed: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), chunk).cast("binary")))


Identify = Callable[[Column, int], Column]


def store(docs: DataFrame, seed: int = 0, identify: Identify = md5_of) -> DataFrame:
    """identifier, chunk: every chunk of the corpus once."""
    chunks = texts(docs).select(F.explode(cut(normalised(F.col("text")))).alias("chunk"))
    return chunks.select(identify(F.col("chunk"), seed).alias("identifier"), "chunk").distinct()


def verified_seed(docs: DataFrame, identify: Identify = md5_of) -> int:
    """The first seed under which no two different chunks of the corpus have one identifier."""
    seed = 0
    while store(docs, seed, identify).groupBy("identifier").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
    return seed


def recipes(docs: DataFrame, seed: int, identify: Identify = md5_of, *more: str) -> DataFrame:
    """doc_id, n_chars (before blanks are deleted), text_sha256 and recipe of every row, and the columns more."""
    held = texts(docs, *more).select("doc_id", *more, F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("text"))
    return held.select("doc_id", *more, "n_chars", sha256(F.col("text")).alias("text_sha256"), F.transform(cut(F.col("text")), lambda c: identify(c, seed)).alias("recipe"))


def restored(made: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, text (without blanks): each recipe read back through the store."""
    parts = made.select(key, F.posexplode_outer("recipe").alias("place", "identifier")).join(chunks, "identifier", "left")
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "chunk"))).alias("parts")).select(key, F.concat_ws("", "parts.chunk").alias("text"))


def groups(docs: DataFrame, identify: Identify = md5_of, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row, and the column row, which tells rows apart, if there is one."""
    seed = verified_seed(docs, identify)
    made = written(recipes(docs, seed, identify, row) if row else recipes(docs, seed, identify).withColumn("row", F.monotonically_increasing_id()), "recipes")
    own = row or "row"
    best = F.struct((-F.col("n_chars")).alias("fewest"), F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col(own).alias("row"))
    found = with_totals(made, ["recipe"], F.col(own), best=("min", best), group_size=("sum", F.lit(1).cast("long")))
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col(own)).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), *([own] if row else []))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = unused([*docs.columns, "doc_id", "text", "n_chars", "text_sha256", "recipe", "best", "group_size"], "row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return held.join(groups(held, row=row).where("kept").select(row), row, "left_semi").select(*docs.columns)

"""Groups of spelling variants by a bit-sliced position index.

Words are counted in Spark. Two words are near if they differ by exactly one inserted, deleted or replaced code point; such words agree in their
first or in their last half, so each is posted to blocks by both halves, and a pair is taken from one block only: by its first half
where that agrees, else by its last. Within a block, INDEX holds for each (position, letter) the bitset of the words that have it there. One pass
over a word's letters carries four bitsets over the whole block: words without an error so far, and with one replaced, inserted or
deleted letter, the latter two at positions shifted by one. A block with more than SLICE words is cut into slices by hash; every word
of the block asks every slice, word by word, so a task holds one slice at a time, whatever the size of the block.

A null text has no words, a null id counts as empty, repeated rows count as often as they stand there, other columns are left out, and ties
go to the smallest word in code-point order.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts, with_totals, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a slice of a block, about.
SLICE = 4096


def dropped(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run, but for one in so many (by document and run) without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, one_in: int | None = 199) -> DataFrame:
    """word, n: words of at least so many code points that occur so often; with one_in, after dropped()."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_chars)
    words = runs.select((dropped(F.col("run"), F.col("doc_id"), one_in) if one_in else F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Index:
    """Bit i of at[p, c] is set if word i has the letter c at position p."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.at: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}

    def add(self, word: str) -> None:
        bit = 1 << len(self.words)
        self.words.append(word)
        self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
        for place in enumerate(word):
            self.at[place] = self.at.get(place, 0) | bit

    def near(self, word: str) -> Iterator[tuple[int, str]]:
        """Number and text of each word that is one error away."""
        at = self.at.get
        exact = longer = (1 << len(self.words)) - 1  # longer: the first letter may be an inserted one
        replaced = shorter = 0
        for p, c in enumerate(word):
            here = at((p, c), 0)
            shorter = shorter & at((p - 1, c), 0) | exact
            replaced = replaced & here | exact & ~here
            exact &= here
            longer = longer & at((p + 1, c), 0) | exact
            if not (exact or replaced or longer or shorter):
                return
        size, of = len(word), self.of_length.get
        found = replaced & of(size, 0) | longer & of(size + 1, 0) | shorter & of(size - 1, 0)
        while found:
            bit = found & -found
            found ^= bit
            i = bit.bit_length() - 1
            yield i, self.words[i]


def _posts(words: DataFrame) -> DataFrame:
    """side, short, half, word, n: a word's blocks. short: the length of the shorter word of a pair (a word may be it, or the longer one)."""
    short = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m > 0)
    posts = words.select("word", "n", F.explode(short).alias("short")).select("*", F.expr("short div 2").cast("int").alias("k"), F.explode(F.array(F.lit("first"), F.lit("last"))).alias("side"))
    half = F.when(F.col("side") == "first", F.substring(F.col("word"), F.lit(1), F.col("k"))).otherwise(F.substring(F.col("word"), F.length("word") - F.col("k") + 1, F.col("k")))
    return posts.select("side", "short", F.xxhash64(half).alias("half"), "word", "n")


def near_pairs(words: DataFrame, size: int = SLICE) -> DataFrame:
    """word, n, other, other_n: all pairs of near words, each in both directions, of a table of word and n (any number; words once)."""
    block = ["side", "short", "half"]
    posts = written(_posts(words), "posts")
    sized = with_totals(posts, block, F.col("word"), in_block=("sum", F.lit(1).cast("long"))).where("in_block > 1")
    slices = F.ceil(F.col("in_block") / size)
    asks = sized.select(*block, "word", "n", F.pmod(F.xxhash64("word"), slices).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    asks = asks.select(*block, "slice", (F.col("own") != F.col("slice")).cast("int").alias("guest"), "word", "n")
    dealt = asks.repartition(partitions(words.sparkSession), *block, "slice").sortWithinPartitions(*block, "slice", "guest")
    return dealt.mapInArrow(_ask, "word string, n long, other string, other_n long")


def _ask(batches: Iterator[pa.RecordBatch], most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows come by slice, its own words before its guests, all of which ask. Own words wait until the slice is whole."""
    rows: list[tuple] = []
    key, index, weights, asked = None, Index(), [], True

    def ask(word: str, n: int) -> None:
        side, short, *_ = key
        k = short // 2
        for i, other in index.near(word):
            if min(len(word), len(other)) == short:
                first = word[:k] == other[:k]
                if first if side == "first" else not first and word[len(word) - k :] == other[len(other) - k :]:
                    rows.append((word, n, other, weights[i]))

    def ask_all() -> None:
        for word, n in zip(index.words, weights, strict=True):
            ask(word, n)

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])
        rows.clear()
        return got

    for b in batches:
        for *own, guest, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if own != key or (guest and not asked):
                if not asked:
                    ask_all()
                if own != key:
                    key, index, weights = own, Index(), []
                asked = bool(guest)
            if guest:
                ask(word, n)
            else:
                index.add(word)
                weights.append(n)
            if len(rows) >= most_rows:
                yield batch()
    if not asked:
        ask_all()
    if rows:
        yield batch()


def forms(words: DataFrame, ratio: int = 5, size: int = SLICE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a table of word and n: the form is the near word of largest n, if that is at
    least ratio (2 or more) times the word's; the root is where forms lead."""
    best = F.min(F.struct((-F.col("other_n")).alias("fewest"), F.col("other").alias("word"))).alias("best")
    near = near_pairs(words, size).groupBy("word").agg(F.count("*").alias("n_near"), best)
    held = words.join(near, "word", "left")
    is_form = -F.col("best.fewest") >= ratio * F.col("n")
    found = written(held.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.fewest")).alias("form_n")), "forms")
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    ends = found.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = int(math.log(max(ends["most"], 1) / max(ends["least"], 1), ratio)) + 1 if ends["most"] is not None else 1  # n grows by the ratio from form to form
    for _ in range(max(0, steps - 1).bit_length()):  # each round doubles how far a root is followed
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        links = written(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")), "roots")
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """forms() of the words of docs."""
    return forms(written(vocabulary(docs), "words"))

"""SpotSigs fingerprints, in JVM expressions only.

Anchors are words so common that every text has them; a signature is the chain of the next content words that follow an
anchor. A text's fingerprint is the set of its signatures. Sets are compared by Jaccard similarity, pairs are looked for
only between sets of like length.

Null text: empty, without signatures; a text without anchors takes every chain of content words, one with too few content
words for a chain has all of its words as one signature. A fingerprint is given whole. Two sets without
signatures are alike (1) if both are empty. Rows with equal ids are ordered by their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, sha256, texts, written

#: Common words that serve as anchors. Fixed values, by language.
COMMON = {
    "en": "a an and are as at be but by for from had has have he her his in is it not of on or that the they this to was were which with you".split(),
    "de": "auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von wie zu".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les ne ou par pas pour qui que sur un une".split(),
    "es": "al como con de del el en es la las lo los no para por que se su un una y".split(),
}
CHAIN = 3
#: Ranges of ids at most: their bounds stand in the plan.
MOST_RANGES = 4000
_BREAKS = ".,;:!?|()\"'\n\r\t\f\v*#$%&<>=/"


def _hash(text: Column) -> Column:
    """64 bits of a hash that other engines have too."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df and the column out: sorted distinct signatures (hashes of chains, 16 hexadecimal digits) of the column text."""
    common = sorted({w for words in COMMON.values() for w in words})
    w, c, s = f"__{out}_words", f"__{out}_content", f"__{out}_chains"
    df = df.withColumn(w, F.filter(F.split(F.translate(F.lower(text), _BREAKS, " " * len(_BREAKS)), " "), lambda x: x != ""))
    tagged = F.transform(w, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(F.col(w), i - 1).isin(common), F.lit(False)).alias("anchored")))
    df = df.withColumn(c, F.filter(tagged, lambda p: ~p["x"].isin(common)))
    chained = F.transform(c, lambda p, i: F.when(i + (chain - 1) < F.size(c), F.struct(p["anchored"].alias("anchored"), _hash(F.concat_ws(" ", p["x"], *(F.get(F.col(c), i + k)["x"] for k in range(1, chain)))).alias("h"))))
    df = df.withColumn(s, F.filter(chained, lambda p: p.isNotNull()))
    spots = F.filter(s, lambda p: p["anchored"])
    some = F.when(F.exists(s, lambda p: p["anchored"]), spots).otherwise(F.col(s))
    short = (F.size(c) < chain) & (F.size(w) > 0)
    return df.withColumn(out, F.when(short, F.array(_hash(F.concat_ws(" ", F.lit("short"), F.col(w))))).otherwise(F.array_sort(F.array_distinct(F.transform(some, lambda p: p["h"]))))).drop(w, c, s)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def shown(signatures: Column) -> Column:
    return F.concat_ws(":", F.size(signatures).cast("string"), F.array_join(signatures, "."))


def _bucket(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    all_ = F.array(*map(F.lit, bounds))
    coarse = F.array(*map(F.lit, bounds[step - 1 :: step] or [bounds[-1]]))
    whole = F.size(F.filter(coarse, lambda b: b <= key)) if len(bounds) >= step else F.lit(0)
    rest = F.slice(all_, whole * step + 1, F.lit(step))
    return whole * step + F.size(F.filter(rest, lambda b: b <= key))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and bucket, own, so that within a bucket, ordered by ("wraps", "doc_id", "text"), each own row is followed
    by its next document. Ids are cut into ranges; each range also holds the first row of the next (of the first, at the end)."""
    source = texts(docs)
    # more ranges than tasks: adaptive execution joins small ones by their bytes, so that long texts side by side stay apart
    parts = parts or min(MOST_RANGES, 4 * max(partitions(docs.sparkSession), source.rdd.getNumPartitions()))
    asked = [i / parts for i in range(1, parts)]
    bounds = source.agg(F.percentile_approx("doc_id", asked, 10_000).alias("b")).first()["b"] if asked else []
    placed = source.withColumn("bucket", F.coalesce(_bucket(F.col("doc_id"), sorted(set(bounds or []))), F.lit(0)))
    # one row for each range: as many as there are partitions, whatever the input
    firsts = placed.select("doc_id", "bucket").groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**62)))).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return placed.withColumns({"own": F.lit(True), "wraps": F.lit(False)})
    key = F.coalesce("doc_id", F.lit(-(2**62)))
    order = [r["bucket"] for r in firsts]
    before = {firsts[i]["first"]: order[i - 1] for i in range(len(firsts))}
    also = F.lit(None).cast("int")
    if len(before) > 0:
        also = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), key)
    is_first = key.isin(list(before))
    copies = F.when(is_first, F.array(F.struct(F.col("bucket"), F.lit(True).alias("own"), F.lit(False).alias("wraps")), F.struct(also.cast("int").alias("bucket"), F.lit(False).alias("own"), (key == firsts[0]["first"]).alias("wraps")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(True).alias("own"), F.lit(False).alias("wraps"))))
    return placed.select("doc_id", "text", F.inline(copies))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = Window.partitionBy("bucket").orderBy("wraps", "doc_id", "text")
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_signatures(rows, "text", "signatures")
    rows = rows.withColumn("next_signatures", F.lead("signatures").over(order)).where("own")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)))
    rows = with_signatures(rows.drop("text", "next_text"), "edited", "edited_signatures")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), sha256(F.col("edited")).alias("edited_sha256"), shown(F.col("signatures")).alias("fingerprint"), shown(F.col("edited_signatures")).alias("edited_fingerprint"),
        jaccard(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), jaccard(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, rep; pairs: a, b, similarity) of texts whose signature sets have a Jaccard similarity of threshold or more.

    Equal sets are one: its smallest id stands for it. Sets are partitioned by length so that only neighbouring partitions can
    hold like sets; of each set only the signatures are looked up that a like one must share (a prefix in hash order), and
    pairs whose lengths rule the similarity out are dropped before sets are compared.
    """
    sets = with_signatures(texts(docs), "text", "signatures").select("doc_id", "signatures", F.sha2(F.array_join("signatures", ","), 256).alias("digest"))
    sets = written(sets, "spotsigs")
    members = sets.join(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest").select("doc_id", "rep")
    own = sets.join(members.where("doc_id = rep"), "doc_id", "left_semi").where(F.size("signatures") > 0).select("doc_id", "signatures", F.size("signatures").alias("n"))
    band = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    looked = own.select("doc_id", "n", band.alias("band"), F.explode(F.slice("signatures", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("h"))
    left = looked.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = looked.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "h", "band")
    fits = (F.col("nb") >= F.col("na")) & (F.col("na") >= F.col("nb") * threshold) & ((F.col("nb") > F.col("na")) | (F.col("a") < F.col("b")))
    found = left.join(right, ["h", "band"]).where(fits).select("a", "b").distinct()
    pair = found.join(own.select(F.col("doc_id").alias("a"), F.col("signatures").alias("sa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("signatures").alias("sb")), "b")
    scored = pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return members, scored.where(F.col("similarity") >= threshold)

"""Exact similarity join of documents by their word n-grams.

The documents' incidence matrix (documents by n-grams) is multiplied by its transpose in blocks of n-grams. Equal sets are one
row of it. Of each row only a prefix enters: the n-grams, the most frequent ones last, of which a similar set must hold one.
A block's product gives, for each pair, how many of these it shares; pairs whose sizes or whose counts and remaining
lengths rule the similarity out are dropped, the others' sets are compared whole.

An n-gram found in few sets gives all their pairs. One found in many gives pairs with a few anchors first. A few partners of
each document are compared; when their links have made components, documents outside a large one are compared with its
member that has most links. Then only pairs across components are left, now with all that they share, and all of these
are compared that the bounds don't rule out. So no link between different components is
lost, and a group of like documents doesn't give all its pairs. Components come from alternating stars
on tables written to the shared folder.

A pair that shares no n-gram found in few sets shares nothing that either set has before its first n-gram found in many, so each
set tells beforehand which sizes a partner can have, and sets meet by classes of sizes. Documents that have a template in common,
and each so much of its own that they can't be linked, thus make no pairs. The n-grams of the frequency list that very many sets
have are cut by the sets' digests, so no task takes all sets of one n-gram; they always count as found in many.

Sets are equal where their sizes and 128-bit digests are; n-grams are known by 64-bit hashes.

Null or empty texts have no n-grams and are linked with nothing. Texts with fewer words than n have one n-gram, the whole. Rows are
known by their ids; where ids repeat, each row is a document of its own with a number of its own, and a group's component_id is
the smallest id of its rows. Null ids are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACES, ids_repeat, mixed, ngram_hashes, partitions, pieces, texts, unused, word_hashes, written

#: Similarity in hundredths.
PERCENT = 75
N = 5
#: An n-gram in more sets than this gives pairs with ANCHORS of them first.
FEW = 24
ANCHORS = 8
#: Of each document so many partners (those with the smallest ids) are compared before components are made.
FIRST = 8
#: At most so many of the most frequent n-grams are put last; which ones only changes the work, never the result.
FREQUENT = 1 << 16
#: An n-gram found more often than this is cut into parts, each with about so many of its sets.
SPLIT = 8192
#: Classes of sizes for each doubling.
CLASSES = 32

ENTRY = np.dtype([("token", "<u8"), ("doc", "<u4"), ("at", "<u4")])
ROW = np.dtype([("id", "<i8"), ("size", "<i4"), ("digest", "<u8")])


def shingles(texts_: list[str], n: int = N) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams, A-Z lower-cased."""
    for words in word_hashes(texts_, lower=True):
        if 0 < len(words) < n:
            yield mixed(np.array([(words * PLACES[: len(words)]).sum() + np.uint64(len(words))], dtype=np.uint64))
        else:
            own = np.sort(ngram_hashes(words, n))
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-size * percent // 100)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of every document; and token, found for n-grams frequent in a chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            all_ = np.concatenate(held)
            cell = (all_ >> np.uint64(44)).astype(np.int32)  # only tokens of cells that are met often can be frequent
            all_ = all_[np.bincount(cell, minlength=1 << 20)[cell] >= 8]
            token, count = np.unique(all_, return_counts=True)
            keep = np.flatnonzero(count >= 8)
            keep = keep[np.argsort(-count[keep], kind="stable")[:4096]]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.binary()), pa.array(token[keep].view(np.int64)), pa.array(count[keep])], names)

        for batch in pieces(batches):
            sets = list(shingles(batch.column("text").to_pylist(), n))
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            k = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
            held += sets
            total += sum(map(len, sets))
            if total >= 2_000_000:
                yield from frequent()
                held, total = [], 0
        if held:
            yield from frequent()

    names = ["doc_id", "n_shingles", "digest", "token", "found"]
    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, token long, found long")


def _incidence(docs: DataFrame, frequent: np.ndarray, parts: np.ndarray, n: int, percent: int, blocks: int) -> DataFrame:
    """block, data: packed prefix entries and the rows (documents) that they belong to. parts: of each frequent n-gram."""
    hot, hot_parts = frequent[parts > 1], parts[parts > 1].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in pieces(batches, 8 << 20):
            rows, entries = [], []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), shingles(batch.column("text").to_pylist(), n), strict=True):
                size = len(tokens)
                if not size or doc is None:
                    continue
                whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
                digest = whole & 0xFFFFFFFFFFFFFFFF
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1) if len(frequent) else None
                last = frequent[at] == tokens if len(frequent) else np.zeros(size, dtype=bool)
                tokens = np.concatenate([tokens[~last], tokens[last]])[: size - int(_needed(np.int64(size), percent)) + 1]
                own = np.empty(len(tokens), ENTRY)
                own["token"], own["doc"], own["at"] = tokens, len(rows), np.arange(len(tokens))
                if (whole, doc) in seen:
                    continue
                seen.add((whole, doc))
                rows.append((doc, size, digest))
                entries.append(own)
            if len(seen) > 100_000:
                seen.clear()
            if not rows:
                continue
            rows, entries = np.array(rows, dtype=ROW), np.concatenate(entries)
            rows, entries = _smallest(rows, entries)
            place = entries["token"] >> np.uint64(20)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, entries["token"]), len(hot) - 1)
                cut = np.flatnonzero(hot[at] == entries["token"])
                place[cut] += rows["digest"][entries["doc"][cut]] % hot_parts[at[cut]]
            block = (place % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            edge = np.searchsorted(block[order], np.arange(blocks + 1))
            out, number = [], []
            for b in range(blocks):
                part = entries[order[edge[b] : edge[b + 1]]]
                if len(part):
                    used, part["doc"] = np.unique(part["doc"], return_inverse=True)
                    head = np.array([len(used), len(part)], dtype="<i8").tobytes()
                    out.append(head + b"".join(rows[c][used].tobytes() for c in ROW.names) + b"".join(part[c].tobytes() for c in ENTRY.names))
                    number.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(out, pa.binary())], ["block", "data"])

    return texts(docs).mapInArrow(run, "block int, data binary")


def _smallest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the entries of rows whose set another row with a smaller id has."""
    order = np.lexsort((rows["id"], rows["size"], rows["digest"]))
    same = np.concatenate([[False], (rows["digest"][order][1:] == rows["digest"][order][:-1]) & (rows["size"][order][1:] == rows["size"][order][:-1])])
    gone = np.zeros(len(rows), dtype=bool)
    gone[order[same]] = True
    return rows, entries[~gone[entries["doc"]]]


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """token, id, size, digest, at of all entries."""
    out = []
    for d in data:
        k, m = np.frombuffer(d, "<i8", 2).tolist()
        at, cols = 16, []
        for kind, names, count in ((ROW, ROW.names, k), (ENTRY, ENTRY.names, m)):
            for c in names:
                cols.append(np.frombuffer(d, kind[c], count, at))
                at += kind[c].itemsize * count
        id_, size, digest, token, doc, place = cols
        out.append((token, id_[doc], size[doc], digest[doc], place))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _fits(size_a, at_a, size_b, at_b, percent: int) -> np.ndarray:
    """Whether sizes, and places of the shared n-gram, leave the similarity possible."""
    size_a, size_b = size_a.astype(np.int64), size_b.astype(np.int64)
    sizes = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    most = 1 + np.minimum(size_a - at_a - 1, size_b - at_b - 1) + np.minimum(at_a, at_b)
    return sizes & ((100 + percent) * most >= percent * (size_a + size_b))


def _product(incidence: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """Pairs: a, b, size_a, size_b, shared (n-grams found in few sets), star (in many, as far as anchors met them). Entries of n-grams in many sets: a (the n-gram), b (id), size_b, shared (place)
    with size_a -1. hot: n-grams that are cut, so that a block has only a part of their sets."""
    names = ["a", "b", "size_a", "size_b", "shared", "star"]

    def batch(a, b, sa, sb, shared, star) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[s].astype(np.int64)), pa.array(b[s].astype(np.int64)), pa.array(sa[s].astype(np.int32)), pa.array(sb[s].astype(np.int32)), pa.array(shared[s].astype(np.int32)), pa.array(star[s].astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [d for x in batches for d in x.column("data").to_pylist()]
        if not data:
            return
        token, id_, size, digest, at = _unpacked(data)
        order = np.lexsort((id_, size, digest, token))
        token, id_, size, digest, at = (x[order] for x in (token, id_, size, digest, at))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])])
        token, id_, size, at = (x[new] for x in (token, id_, size, at))  # of equal sets the smallest id
        edge = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
        count = np.diff(edge)
        docs, local = np.unique(id_, return_inverse=True)
        size_of = np.zeros(len(docs), dtype=np.int64)
        size_of[local] = size
        found: list[np.ndarray] = []
        partial: list[np.ndarray] = []

        def pair(i: np.ndarray, j: np.ndarray, part: bool) -> None:
            ok = (id_[i] != id_[j]) & _fits(size[i], at[i], size[j], at[j], percent)
            i, j = local[i[ok]], local[j[ok]]
            found.append(np.minimum(i, j) * len(docs) + np.maximum(i, j))
            partial.append(np.full(len(i), part))

        whole = ~np.isin(token[edge[:-1]], hot)
        for k in range(2, FEW + 1):
            starts = edge[:-1][(count == k) & whole]
            left, right = np.triu_indices(k, 1)
            for part in range(0, len(starts), max(1, 2_000_000 // len(left))):
                s = starts[part : part + max(1, 2_000_000 // len(left)), None]
                pair((s + left).ravel(), (s + right).ravel(), False)
        many = np.flatnonzero((count > FEW) | ~whole)
        for g in many:
            own = np.arange(edge[g], edge[g + 1])
            own = own[np.argsort(id_[own], kind="stable")]
            for anchor in own[:ANCHORS]:
                pair(np.full(len(own), anchor), own, True)
        if found:
            key, part = np.concatenate(found), np.concatenate(partial)
            key, back, seen = np.unique(key, return_inverse=True, return_counts=True)
            star = np.bincount(back, part, len(key)).astype(np.int64)
            i, j = key // len(docs), key % len(docs)
            yield from batch(docs[i], docs[j], size_of[i], size_of[j], seen - star, star)
        if len(many):
            rows = np.concatenate([np.arange(edge[g], edge[g + 1]) for g in many])
            minus = np.full(len(rows), -1)
            yield from batch(token[rows].view(np.int64), id_[rows], minus, size[rows], at[rows], np.zeros(len(rows)))

    return incidence.mapInArrow(run, "a long, b long, size_a int, size_b int, shared int, star int")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes, shared n-grams of their prefixes and remaining lengths leave the similarity possible."""
    rest = F.ceil(F.greatest("size_a", "size_b") * percent / 100) - 1
    return pairs.where((100 + percent) * (F.col("shared") + F.col("star") + rest) >= percent * (F.col("size_a") + F.col("size_b")))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            good = []
            for a, ta, other in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), shingles(batch.column("text_b").to_pylist(), n), strict=True):
                if last != (a, ta):
                    last, own = (a, ta), next(shingles([ta], n))
                both = np.sort(np.concatenate([own, other]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    source = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    right = pairs.join(source.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(source.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) of all nodes that have links (a, b): rounds until nothing changes, which alternating
    stars take about as many of as the logarithm of the largest component's size."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node with the least of its neighbourhood, then the same for the smaller neighbours
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def _to_hubs(entries: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of the documents outside an n-gram's main component, where that is large, with the member of it that has most links."""
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    own = entries.join(labels.join(degree, "node", "left"), entries.id == F.col("node"), "left").select("token", "id", "size", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    parts = own.groupBy("token", "component").agg(F.count("*").alias("k"), F.max(F.struct("degree", (-F.col("id")).alias("minus"), "size")).alias("hub"))
    main = parts.groupBy("token").agg(F.max(F.struct("k", "component", "hub")).alias("m")).where(F.col("m.k") > FEW)
    main = main.select("token", F.col("m.component").alias("main"), (-F.col("m.hub.minus")).alias("hub"), F.col("m.hub.size").alias("hub_size"))
    met = own.join(main, "token").where((F.col("component") != F.col("main")) & (100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")))
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _class(size: Column) -> Column:
    return F.floor(F.log2(size) * CLASSES).cast("int")


def _crossing(entries: DataFrame, pairs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among the sets that share a frequent n-gram, with how many of these they share (star): each member
    outside the n-gram's main component with all others.

    Pairs that also share n-grams found in few sets are known, and looked up. For all others, the first n-gram that a similar pair
    has in common is in both prefixes and found in many sets; so the pair has in common no more than what either set has from its
    first such n-gram on, which leaves it partners up to a size (upto), and sets meet by classes of sizes. Where an n-gram's main
    component is large, its members share many n-grams, so each set meets the others once, by component, with all of them; the
    bound on what the pair can share is part of the join. Elsewhere sets meet by n-gram."""
    least = F.ceil(F.col("size") * percent / 100)
    upto = F.least(F.floor(F.col("size") * 100 / percent), F.floor((F.col("size") - F.col("first")) * (100 + percent) / percent) - F.col("size"))
    held = entries.groupBy("id").agg(F.min("at").alias("first"), F.count("*").alias("total"), F.first("size").alias("size"))
    held = held.join(labels, held.id == labels.node, "left").select("id", "total", F.coalesce("component", "id").alias("component"), least.alias("least"), upto.alias("upto"))
    own = entries.join(held.where("upto >= least"), "id")
    main = own.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("m"))
    own = own.join(main.select("token", F.col("m.component").alias("main"), (F.col("m.k") > FEW).alias("large")), "token")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    apart = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main")) | (F.col("id_a") < F.col("id_b")))
    apart &= (100 * small >= percent * large) & (F.col("size_b") <= F.col("upto_a")) & (F.col("size_a") <= F.col("upto_b"))
    need = percent * (F.col("size_a") + F.col("size_b"))

    def met_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        """Each row outside its main component (_a) with the rows (_b) of the same key whose sizes it may have as partners."""
        left = df.where("component <> main").withColumn("class", F.explode(F.sequence(_class(F.col("least")), _class(F.col("upto")))))
        left = left.select(key, "class", *(F.col(c).alias(f"{c}_a") for c in columns))
        right = df.select(*dict.fromkeys([key, "main"]), _class(F.col("size")).alias("class"), *(F.col(c).alias(f"{c}_b") for c in columns))
        return left.join(right, [key, "class"]).where(apart)

    most = 1 + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1) + F.least("at_a", "at_b")
    by_token = met_by(own.where(~F.col("large")), "token", ["id", "size", "at", "component", "upto"]).where((100 + percent) * most >= need).withColumn("star", F.lit(1).cast("long"))

    # a set's n-grams of one main component (no more than its prefix has), and how many it has in other large groups
    sets = own.where("large").groupBy("id", "main").agg(*(F.first(c).alias(c) for c in ("size", "component", "least", "upto", "total")), F.collect_list("token").alias("tokens"))
    sets = sets.withColumn("other", F.col("total") - F.size("tokens"))
    met = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    rest = F.ceil(large * percent / 100) - 1
    by_main = met_by(sets, "main", ["id", "size", "component", "upto", "tokens", "other"])
    by_main = by_main.where((met > 0) & ((100 + percent) * (met + F.least("other_a", "other_b") + rest) >= need)).withColumn("star", met)

    ordered = F.col("id_a") < F.col("id_b")
    out = [F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.when(ordered, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(ordered, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"), "star"]
    found = by_token.select(*out).union(by_main.select("main", *out).distinct().drop("main"))

    tokens = entries.groupBy("id").agg(F.collect_list("token").alias("tokens"))
    side = lambda c: tokens.join(held, "id").select(F.col("id").alias(c), F.col("tokens").alias(f"tokens_{c}"), F.col("component").alias(f"component_{c}"))
    known = pairs.where("shared > 0").join(side("a"), "a").join(side("b"), "b").where((F.col("component_a") != F.col("component_b")) & (met > 0))
    both = found.withColumn("known", F.lit(None).cast("long")).union(known.select("a", "b", "size_a", "size_b", F.lit(0).cast("long"), met))
    star = F.coalesce(F.max("known"), F.sum("star"))
    return both.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), star.alias("star"))


def _with_crossing(pairs: DataFrame, crossing: DataFrame) -> DataFrame:
    """All pairs; those across components with all that they share: n-grams found in few sets, and in many."""
    both = pairs.select("a", "b", "size_a", "size_b", "shared", F.lit(0).cast("long").alias("star")).unionByName(crossing.withColumn("shared", F.lit(0).cast("long")))
    return both.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("shared").alias("shared"), F.sum("star").alias("star"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose members are in different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    held = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return held.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that is reached by links, the document's own included."""
    if not ids_repeat(docs):
        return _joined(docs, n, percent)
    return _by_number(_numbered(docs.select("doc_id", "text"), "node"), "node", n, percent).select("doc_id", "n_shingles", "component_id")


def _numbered(docs: DataFrame, node: str) -> DataFrame:
    """docs with a number for each row, as a written table, so that the numbers stay."""
    return written(docs.withColumn(node, F.monotonically_increasing_id()), "numbered")


def _by_number(numbered: DataFrame, node: str, n: int, percent: int) -> DataFrame:
    """node, doc_id, n_shingles, component_id, first (the number of a group's row that has its smallest id)."""
    own = numbered.select(F.col(node).alias("node"), F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), F.col(node)).alias("doc_id"), "text")
    found = _joined(own, n, percent).where("doc_id is not null").select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("part"))
    ids = own.select("node", "id").join(found, "node").select("node", "id", "n_shingles", "part")
    least = ids.groupBy("part").agg(F.min(F.struct("id", "node")).alias("least"))
    done = ids.join(least, "part").select("node", F.col("id").alias("doc_id"), "n_shingles", F.col("least.id").alias("component_id"), F.col("least.node").alias("first"))
    rest = own.where("id is null").select("node", "id", "text")
    null = _profile(rest.select(F.col("node").alias("doc_id"), "text"), n).where("digest is not null").select(F.col("doc_id").alias("node"), F.lit(None).cast(own.schema["id"].dataType).alias("doc_id"), "n_shingles", F.lit(None).cast(own.schema["id"].dataType).alias("component_id"), F.col("doc_id").alias("first"))
    return done.unionByName(null)


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    profile = written(_profile(docs, n), "profile")
    sums = profile.where("token is not null").groupBy("token").agg(F.sum("found").alias("found")).where("found >= 64")
    rows = sums.orderBy(F.desc("found"), "token").limit(FREQUENT).toArrow()  # bounded by FREQUENT
    frequent, times = rows["token"].to_numpy().astype(np.int64).view(np.uint64), rows["found"].to_numpy()
    order = np.argsort(frequent)
    frequent, parts = frequent[order], 1 + times[order] // SPLIT
    blocks = max(partitions(spark), 2 * docs.rdd.getNumPartitions())  # a block's size does not grow with the input
    incidence = _incidence(docs, frequent, parts, n, percent, blocks)
    found = written(_product(incidence.repartition(blocks, "block"), percent, frequent[parts > 1]), "pairs")
    sums = found.where("size_a >= 0").groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("shared").alias("shared"), F.sum("star").alias("star"))
    pairs = written(sums, "pairs")
    # first a few partners of each document; then what is left between the components that these links make
    partner = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    tried = written(_possible(pairs, percent).select("a", "b").withColumn("k", partner).where(F.col("k") <= FIRST).select("a", "b"), "tried")
    links = written(_verified(tried, docs, n, percent), "links")
    labels = components(links)
    entries = found.where("size_a < 0").select(F.col("a").alias("token"), F.col("b").alias("id"), F.col("size_b").alias("size"), F.col("shared").alias("at"))
    hubs = written(_to_hubs(entries, links, labels, percent).join(tried, ["a", "b"], "left_anti"), "tried")
    near = written(_verified(hubs, docs, n, percent), "links")
    if near.limit(1).count():
        tried, links = tried.union(hubs), links.union(near)
        labels = components(links)
    rest = _across(_possible(_with_crossing(pairs, _crossing(entries, pairs, labels, percent)), percent).select("a", "b"), labels).join(tried, ["a", "b"], "left_anti")
    more = written(_verified(written(rest, "tried"), docs, n, percent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    documents = profile.where("digest is not null")
    reps = documents.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    own = documents.select("doc_id", "n_shingles", "digest").join(reps, ["digest", "n_shingles"], "left")
    reached = own.join(labels, own.rep == labels.node, "left")
    return reached.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """All columns of docs; of each group of linked documents that with the smallest id stays, one row of it. Null ids stay."""
    if not ids_repeat(docs):
        gone = join(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    node = unused(docs.columns, "node")
    own = _numbered(docs, node)
    stays = _by_number(own, node, n, percent).where("first = node").select(F.col("node").alias(node))
    return own.join(stays, node, "left_semi").select(*docs.columns)

"""Grids over skies, and moments, boxes and statistics of images kept as pixel rows.

A grid has a fixed number of points, given by parameters. Galaxies are exchanged once, by sky, and each sky gives one row of sums at all points;
a sky with more than CROWDED galaxies is dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import kept

#: Side of a sky. Fixed value.
SIDE = 4200


def tangential(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """The ellipticity of a galaxy along the tangent about a centre."""
    angle = F.atan2(y - cy, x - cx)
    return -(F.col("e1") * F.cos(2 * angle) + F.col("e2") * F.sin(2 * angle))


def grid_signal(skies: DataFrame, cells: int = 15) -> DataFrame:
    """sky_id, i, j, signal: mean tangential ellipticity of the galaxies in a cell about its centre; empty cells 0."""
    w = SIDE / cells
    held = skies.withColumns({"i": F.floor(F.col("x") / w).cast("int"), "j": F.floor(F.col("y") / w).cast("int")})
    signal = held.groupBy("sky_id", "i", "j").agg(F.avg(tangential(F.col("x"), F.col("y"), (F.col("i") + 0.5) * w, (F.col("j") + 0.5) * w)).alias("signal"))
    steps = F.sequence(F.lit(0), F.lit(cells - 1))
    grid = skies.select("sky_id").distinct().withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return grid.join(signal, ["sky_id", "i", "j"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))


#: Galaxies that meet the grid at once in a task, sums that a task holds at once, and galaxies of a sky from which on several tasks share it.
SLICE, HELD, CROWDED = 2048, 1 << 22, 1 << 17


def _packed(skies: DataFrame, n: int, columns: Sequence[str], names: Sequence[str], of: Callable[..., np.ndarray], crowded: int = CROWDED, finish: Callable[[pa.Array, np.ndarray], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """sky_id and, by name, an array of the sums over a sky's galaxies at n x n points, row by row. of: from where each sky's galaxies begin, x, y
    and the columns (all ordered by sky) the sums by name, sky and point. The galaxies of a sky meet in one task and come there one after
    another, so it gives one row for each sky, never one for each galaxy, batch and point; a crowded sky is dealt over tasks by hash, and its few rows
    are added up. A galaxy without a sky, place or value doesn't count. With finish, the rows of the schema (after sky_id) that it makes of skies and their sums
    come instead, made in the same task."""
    kind = skies.schema["sky_id"].dataType.simpleString()

    def rows(sky: pa.Array, made: np.ndarray) -> pa.RecordBatch:
        edge = pa.array(np.arange(len(sky) + 1, dtype=np.int32) * n * n)
        return pa.RecordBatch.from_arrays([sky, *(pa.ListArray.from_arrays(edge, pa.array(m.ravel())) for m in made)], ["sky_id", *names])

    def sums(give: Callable[[pa.Array, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        step = max(1, HELD // (len(names) * n * n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                sky, *values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sky_id", "x", "y", *columns))
                begin = np.flatnonzero(np.r_[True, sky[1:] != sky[:-1]])
                for k in range(0, len(begin), step):
                    first = begin[k : k + step]
                    rows_of = slice(first[0], begin[k + step] if k + step < len(begin) else len(sky))
                    own, made = sky[first], of(first - first[0], *(v[rows_of] for v in values)).reshape(len(names), len(first), n * n)
                    if last is not None and last[0][0] == own[0]:
                        made[:, 0] += last[1][:, 0]
                    elif last is not None:
                        yield give(pa.array(last[0]), last[1])
                    if len(own) > 1:
                        yield give(pa.array(own[:-1]), made[:, :-1])
                    last = own[-1:], made[:, -1:].copy()
            if last is not None:
                yield give(pa.array(last[0]), last[1])

        return run

    arrays = f"sky_id {kind}, " + ", ".join(f"{c} array<double>" for c in names)
    out = f"sky_id {kind}, {schema}" if finish else arrays
    whole_sums, part_sums = sums(finish or rows), sums(rows)
    held = skies.where("sky_id is not null").select("sky_id", *(F.col(c).cast("double") for c in ("x", "y", *columns))).na.drop()
    many = kept(held.groupBy("sky_id").agg(F.count("*").alias("__n")).where(F.col("__n") > crowded), "crowded-skies")
    tasks = int(skies.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: a few bytes of galaxies are much work
    if many.isEmpty():
        return held.repartition(tasks, "sky_id").sortWithinPartitions("sky_id").mapInArrow(whole_sums, out)
    whole = held.join(F.broadcast(many), "sky_id", "left_anti").repartition(tasks, "sky_id").sortWithinPartitions("sky_id").mapInArrow(whole_sums, out)
    dealt = held.join(F.broadcast(many), "sky_id").withColumn("__slice", F.pmod(F.xxhash64("x", "y", *columns), F.ceil(F.col("__n") / crowded)))
    parts = dealt.drop("__n").repartition(tasks, "sky_id", "__slice").sortWithinPartitions("sky_id", "__slice").drop("__slice").mapInArrow(part_sums, arrays)
    points = parts.select("sky_id", F.posexplode(F.arrays_zip(*names)).alias("__k", "s")).groupBy("sky_id", "__k").agg(*[F.sum(f"s.{c}").alias(c) for c in names])
    again = points.groupBy("sky_id").agg(F.sort_array(F.collect_list(F.struct("__k", *names))).alias("s"))
    again = again.select("sky_id", *[F.col(f"s.{c}").alias(c) for c in names])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield finish(one.column("sky_id"), np.stack([one.column(c).flatten().to_numpy() for c in names])[:, None])

    return whole.unionByName(again.mapInArrow(finished, out) if finish else again)


def _unpacked(packed: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    """sky_id, i, j and the values by name: a row for each sky and point."""
    rows = packed.select("sky_id", F.posexplode(F.arrays_zip(*names)).alias("k", "s"))
    return rows.select("sky_id", F.floor(F.col("k") / n).cast("int").alias("i"), (F.col("k") % n).alias("j"), *[F.col(f"s.{c}").alias(c) for c in names])


def _points(n: int) -> np.ndarray:
    return (np.arange(n) + 0.5) * SIDE / n


def grid_sums(skies: DataFrame, n: int, columns: Sequence[str], names: Sequence[str], of: Callable[..., Sequence[np.ndarray]], crowded: int = CROWDED) -> DataFrame:
    """sky_id and arrays of sums as _packed gives them. of: from distances in x and y (galaxies by points of the grid) and the columns
    (galaxies by 1 by 1) the summands by name."""
    at = _points(n)

    def sums(first: np.ndarray, x: np.ndarray, y: np.ndarray, *values: np.ndarray) -> np.ndarray:
        total = np.zeros((len(names), len(first), n, n))
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        for k in range(0, len(x), SLICE):
            rows = slice(k, k + SLICE)
            own = owner[rows]
            start = np.flatnonzero(np.diff(own, prepend=-1))
            made = of(x[rows, None, None] - at[:, None], y[rows, None, None] - at[None, :], *(v[rows, None, None] for v in values))
            for t, part in zip(total, made, strict=True):
                t[own[start]] += np.add.reduceat(np.broadcast_to(part, (len(own), n, n)), start, axis=0)
        return total

    return _packed(skies, n, columns, names, sums, crowded)


def _likelihoods(skies: DataFrame, n: int) -> DataFrame:
    def off(dx, dy, e1, e2):
        r = np.hypot(dx, dy)
        angle, r = 2 * np.arctan2(dy, dx), np.maximum(r, 1.0)
        return [(e1 + np.cos(angle) / r) ** 2 + (e2 + np.sin(angle) / r) ** 2]

    return grid_sums(skies, n, ["e1", "e2"], ["off"], off).select("sky_id", F.transform("off", lambda x: F.exp(-0.5 * x)).alias("likelihood"))


def grid_likelihood(skies: DataFrame, n: int = 10) -> DataFrame:
    """sky_id, i, j, likelihood: exp(-1/2 sum of squared differences from a model whose distortion falls as 1/r about the point)."""
    return _unpacked(_likelihoods(skies, n), n, ["likelihood"])


def argmax_likelihood(skies: DataFrame, n: int = 10, places: int = 12) -> DataFrame:
    """sky_id, i, j: the point of the largest likelihood, rounded to places; ties: the first."""
    return _first(_likelihoods(skies, n).withColumn("likelihood", F.transform("likelihood", lambda x: F.round(x, places))), n, "likelihood", -1, "m").select("sky_id", F.col("m_i").alias("i"), F.col("m_j").alias("j"))


def grid_distances(skies: DataFrame, n: int = 5) -> DataFrame:
    """sky_id, i, j, n and far: number of a sky's galaxies and the sum of their distances to each point."""
    made = grid_sums(skies, n, [], ["n", "far"], lambda dx, dy: [np.ones(1), np.hypot(dx, dy)])
    return _unpacked(made, n, ["n", "far"]).withColumn("n", F.col("n").cast("long"))


_MAPS = ["e1_mean", "e2_mean", "e1_var", "e2_var", "e_cov"]
#: What is made of the maps besides: sum and distance of the variances.
_MORE = {"var_sum": lambda m: m["e1_var"] + m["e2_var"], "var_gap": lambda m: np.abs(m["e1_var"] - m["e2_var"])}


def _kernel_maps(skies: DataFrame, n: int, sd: float, crowded: int = CROWDED, finish: Callable[[pa.Array, dict], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """sky_id and the maps as arrays, or what finish makes of skies and their maps by name (skies by points). The weight is a product of one for x
    and one for y, so the sums of a sky's galaxies over the grid are small matrix products."""
    at = _points(n)

    def sums(first: np.ndarray, x: np.ndarray, y: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
        wx, wy = (np.exp(-((v[:, None] - at) ** 2) / (2 * sd * sd)) for v in (x, y))
        values = np.stack([np.ones(len(x)), e1, e2, e1 * e1, e2 * e2, e1 * e2])
        own = [slice(a, b) for a, b in zip(first, np.r_[first[1:], len(x)], strict=True)]
        made = np.empty((6, len(own), n * n))
        for k, s in enumerate(own):
            made[:, k] = ((values[:, None, s] * wx[s].T).reshape(-1, s.stop - s.start) @ wy[s]).reshape(6, n * n)
        return made

    def arrays(sky: pa.Array, maps: dict) -> pa.RecordBatch:
        edge = pa.array(np.arange(len(sky) + 1, dtype=np.int32) * n * n)
        return pa.RecordBatch.from_arrays([sky, *(pa.ListArray.from_arrays(edge, pa.array(maps[c].ravel())) for c in _MAPS)], ["sky_id", *_MAPS])

    def made(sky: pa.Array, found: np.ndarray) -> pa.RecordBatch:
        a, b, aa, bb, ab = found[1:] / found[0]
        return (finish or arrays)(sky, {"e1_mean": a, "e2_mean": b, "e1_var": aa - a * a, "e2_var": bb - b * b, "e_cov": ab - a * b})

    return _packed(skies, n, ["e1", "e2"], ["w", "a", "b", "aa", "bb", "ab"], sums, crowded, made, schema if finish else ", ".join(f"{c} array<double>" for c in _MAPS))


def grid_kernel_maps(skies: DataFrame, n: int = 14, sd: float = 1000.0, crowded: int = CROWDED) -> DataFrame:
    """sky_id, i, j and Gaussian-weighted means of e1 and e2, their variances and covariance about each point. A galaxy without a sky, place
    or shape doesn't count."""

    def rows(sky: pa.Array, maps: dict) -> pa.RecordBatch:
        k = np.tile(np.arange(n * n, dtype=np.int32), len(sky))
        return pa.RecordBatch.from_arrays([sky.take(pa.array(np.repeat(np.arange(len(sky)), n * n))), pa.array(k // n), pa.array(k % n), *(pa.array(maps[c].ravel()) for c in _MAPS)], ["sky_id", "i", "j", *_MAPS])

    return _kernel_maps(skies, n, sd, crowded, rows, "i int, j int, " + ", ".join(f"{c} double" for c in _MAPS))


def _first(maps: DataFrame, n: int, column: str, sign: int, name: str) -> DataFrame:
    """name, name_i, name_j: the largest (sign -1) or smallest (1) value of a map that is an array, and where it is; ties: the first point."""
    m = F.array_min(F.transform(column, lambda v, k: F.struct((sign * v).alias("v"), k.alias("k"))))
    return maps.withColumn("__m", m).withColumns({name: sign * F.col("__m.v"), f"{name}_i": F.floor(F.col("__m.k") / n).cast("int"), f"{name}_j": F.col("__m.k") % n}).drop("__m")


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero."""
    v = x * 10.0**places
    whole = np.trunc(v)
    return np.where(np.abs(v - whole) == 0.5, whole + np.sign(v), np.rint(v)) / 10.0**places


def argmax_argmin(skies: DataFrame, columns: Sequence[str], n: int = 14, sd: float = 1000.0, places: int = 9, crowded: int = CROWDED) -> DataFrame:
    """For each sky and each of these kernel maps (or sum and distance of the variances: var_sum, var_gap), rounded to places, the largest and
    smallest value and where they are; ties: the first cell. They are found where a sky's sums are made, so nothing is exchanged after them."""

    def best(sky: pa.Array, maps: dict) -> pa.RecordBatch:
        found, names = [sky], ["sky_id"]
        for c in columns:
            own = _rounded(_MORE[c](maps) if c in _MORE else maps[c], places)
            for tag, at in (("max", own.argmax(axis=1)), ("min", own.argmin(axis=1))):
                found += [pa.array(own[np.arange(len(own)), at]), pa.array((at // n).astype(np.int32)), pa.array((at % n).astype(np.int32))]
                names += [f"{c}_{tag}", f"{c}_{tag}_i", f"{c}_{tag}_j"]
        return pa.RecordBatch.from_arrays(found, names)

    return _kernel_maps(skies, n, sd, crowded, best, ", ".join(f"{c}_{t} double, {c}_{t}_i int, {c}_{t}_j int" for c in columns for t in ("max", "min")))


def _field(name: str):
    return lambda row: row[name]


def pad_flatten(skies: DataFrame, key: str, order: str, columns: Sequence[str], width: int) -> DataFrame:
    """One row for each sky: its centred points in order, one column's values after another's, padded with 0 to width points. A
    sky with more points than width fails the job rather than losing any."""
    means = skies.groupBy(key).agg(*[F.avg(c).alias(f"__{c}") for c in columns], F.count("*").alias("n"))
    held = skies.join(means, key).select(key, "n", F.struct(order, *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in columns]).alias("p"))
    one = held.groupBy(key).agg(F.first("n").alias("n"), F.sort_array(F.collect_list("p")).alias("p"))
    checked = F.when(F.size("p") > width, F.raise_error(F.lit("more points than the width"))).otherwise(F.col("p"))
    pad = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("p"))
    flat = F.concat(*[F.concat(F.transform(checked, _field(c)), pad) for c in columns])
    return one.select(key, "n", flat.alias("flat"))


def image_moments(pixels: DataFrame, background: float = 255.0) -> DataFrame:
    """Raw moments of the inverted grey values of non-background pixels, centroid, and the angle of the principal axis."""
    v = F.when(F.col("v") < background, background - F.col("v")).otherwise(0.0)
    x, y = F.col("c"), F.col("r")
    m = pixels.groupBy("image_id").agg(F.sum(v).alias("m00"), F.sum(v * x).alias("m10"), F.sum(v * y).alias("m01"), F.sum(v * x * y).alias("m11"), F.sum(v * x * x).alias("m20"), F.sum(v * y * y).alias("m02"))
    xc, yc = F.try_divide("m10", "m00"), F.try_divide("m01", "m00")
    u11, u20, u02 = F.try_divide("m11", "m00") - xc * yc, F.try_divide("m20", "m00") - xc * xc, F.try_divide("m02", "m00") - yc * yc
    return m.select("*", xc.alias("x_center"), yc.alias("y_center"), (0.5 * F.atan2(2 * u11, u20 - u02)).alias("angle"))


def image_trim(pixels: DataFrame, background: float = 255.0) -> DataFrame:
    """Pixels inside the box of non-background rows and columns, counted from the box's corner."""
    ink = pixels.where(F.col("v") < background)
    box = ink.groupBy("image_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    held = pixels.join(box, "image_id").where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    return held.select("image_id", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v")


def image_pixel_stats(pixels: DataFrame, background: float = 255.0, at: Sequence[float] = (5, 25, 50, 75, 95)) -> DataFrame:
    """area, share of pixels that are not background and their mean, share below the mean, percentiles."""
    means = pixels.groupBy("image_id").agg(F.avg("v").alias("mean"))
    held = pixels.join(means, "image_id")
    ink = F.col("v") < background
    one = held.groupBy("image_id").agg(F.count("*").alias("area"), F.avg(ink.cast("double")).alias("filled"), F.avg(F.when(ink, F.col("v"))).alias("mean_filled"), F.avg((F.col("v") < F.col("mean")).cast("double")).alias("below_mean"), F.percentile("v", [x / 100 for x in at]).alias("p"))
    return one.select("image_id", "area", "filled", "mean_filled", "below_mean", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate(at)])


def append_features(rows: DataFrame, features: DataFrame, key: str, values: str, columns: Sequence[str]) -> DataFrame:
    """The original array with computed columns at its end."""
    return rows.join(features.select(key, *columns), key).select(key, F.concat(F.col(values), F.array(*[F.col(c).cast("double") for c in columns])).alias(values))

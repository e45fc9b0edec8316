"""Image jobs that expressions can't say: connected regions, resizing and turning. Arrow batches of images, NumPy within."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_arrays(pixels: DataFrame) -> DataFrame:
    """image_id, h, w, flat (row by row) from pixel rows; an image is one row."""
    one = pixels.groupBy("image_id").agg((F.max("r") + 1).cast("int").alias("h"), (F.max("c") + 1).cast("int").alias("w"), F.sort_array(F.collect_list(F.struct("r", "c", "v"))).alias("p"))
    return one.select("image_id", "h", "w", F.transform("p", lambda q: q["v"].cast("double")).alias("flat"))


def labelled_regions(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected regions of a mask, by ascending last pixel; 0 outside. One pass over the runs of each row joins those that
    touch runs of the row above, a second one writes their numbers."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # behind the run
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    a, b = start.tolist(), end.tolist()
    for r in range(1, mask.shape[0]):
        above, here = first[r - 1], first[r]
        while above < first[r] and here < first[r + 1]:
            if a[above] <= b[here] and a[here] <= b[above]:
                x, y = sorted((find(above), find(here)))
                root[x] = y  # the later run stands for both
            if b[above] < b[here]:
                above += 1
            else:
                here += 1
    label = np.zeros(mask.shape, dtype=np.int64)
    roots = [find(i) for i in range(len(row))]
    number = {k: n for n, k in enumerate(sorted(set(roots)), 1)}
    for i, k in enumerate(roots):
        label[row[i], a[i] : b[i]] = number[k]
    return label


def filled_area(mask: np.ndarray) -> int:
    """Pixels of a region and its holes: what isn't reached from outside, 8-connected."""
    outside = labelled_regions(~np.pad(mask, 1))
    return int((outside[1:-1, 1:-1] != outside[0, 0]).sum())


def dilated(mask: np.ndarray) -> np.ndarray:
    pad = np.pad(mask, 1)
    return np.any([pad[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)


def region_stats(images: DataFrame) -> DataFrame:
    """Per image: dark pixels (below the mean) in regions, those that touch when grown by a 3 x 3 square. number of regions; filled area of
    the largest, its dark pixels, the mean filled area, the largest one's share of the pixels that aren't white (255), its ratio to the
    smallest and to the mean, and the largest one's ratio of minor to major axis. -1 for what isn't there; of equal areas counts the one
    that ends first."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = np.asarray(r.flat, dtype=float).reshape(r.h, r.w)
                dark = image < image.mean()
                label = labelled_regions(dilated(dark)) * dark
                areas = []
                for n in range(1, int(label.max(initial=0)) + 1):
                    y, x = np.nonzero(label == n)
                    areas.append(filled_area(label[y.min() : y.max() + 1, x.min() : x.max() + 1] == n))
                if not areas:
                    rows.append((r.image_id, 0, -1, -1, -1.0, -1.0, -1.0, -1.0, -1.0))
                    continue
                top = int(np.argmax(areas))
                y, x = np.nonzero(label == top + 1)
                low, big = np.linalg.eigvalsh(np.cov(np.stack([x, y]).astype(float), bias=True))
                ratio = float(np.sqrt(max(low, 0) / big)) if big > 1e-12 else -1.0
                rows.append((r.image_id, len(areas), areas[top], len(x), float(np.mean(areas)), areas[top] / float((image < 255).sum()), areas[top] / min(areas), areas[top] / float(np.mean(areas)), ratio))
            yield pd.DataFrame(rows, columns=["image_id", "n_regions", "largest", "dark", "mean_size", "largest_share", "to_smallest", "to_mean", "axis_ratio"])

    return images.mapInPandas(run, "image_id long, n_regions long, largest long, dark long, mean_size double, largest_share double, to_smallest double, to_mean double, axis_ratio double")


def resized(image: np.ndarray, h: int, w: int, degrees: float = 0.0, background: float = 255.0) -> np.ndarray:
    """Bilinear, turned about the centre; background outside."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    sy, sx = (y + 0.5) * image.shape[0] / h - 0.5, (x + 0.5) * image.shape[1] / w - 0.5
    cy, cx, a = (image.shape[0] - 1) / 2, (image.shape[1] - 1) / 2, np.deg2rad(degrees)
    dy, dx = sy - cy, sx - cx
    sy, sx = cy + dy * np.cos(a) - dx * np.sin(a), cx + dy * np.sin(a) + dx * np.cos(a)
    pad = np.pad(image, 2, constant_values=background)
    sy, sx = np.clip(sy + 2, 0, pad.shape[0] - 1.001), np.clip(sx + 2, 0, pad.shape[1] - 1.001)
    i, j = sy.astype(int), sx.astype(int)
    fy, fx = sy - i, sx - j
    return pad[i, j] * (1 - fy) * (1 - fx) + pad[i + 1, j] * fy * (1 - fx) + pad[i, j + 1] * (1 - fy) * fx + pad[i + 1, j + 1] * fy * fx


def augment(images: DataFrame, h: int, w: int, angles: Sequence[float] = (0, 90, 180, 270)) -> DataFrame:
    """image_id, angle, flat: an inverted copy of the resized image for each angle."""

    def run(batches):
        for pdf in batches:
            rows = [(r.image_id, float(a), (255 - resized(np.asarray(r.flat, dtype=float).reshape(r.h, r.w), h, w, a)).ravel().tolist()) for r in pdf.itertuples(index=False) for a in angles]
            yield pd.DataFrame(rows, columns=["image_id", "angle", "flat"])

    return images.mapInPandas(run, "image_id long, angle double, flat array<double>")

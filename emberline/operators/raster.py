"""Tile grids, percentile stretch, tile statistics, and building boxes from height rasters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.boxes import stretched
from emberline.operators.scan import running_total
from emberline.session import cut


def offsets(extent: Column, size: int | Column, stride: int | Column, mode: str) -> Column:
    """Array of tile offsets along one axis.

    pad: from 0 while below max(extent - size + 1, 1), the last tile may need padding; snap: those that fit and the
    last one moved to the edge; drop: only those that fit, none where the extent is smaller than a tile.
    """
    size = F.lit(size) if isinstance(size, int) else size
    stride = F.lit(stride) if isinstance(stride, int) else stride
    fits = F.sequence(F.lit(0), F.greatest(extent - size, F.lit(0)), stride)
    if mode == "pad":
        return fits
    if mode == "snap":
        return F.array_union(fits, F.array(F.greatest(extent - size, F.lit(0)).cast("int")))
    if mode == "drop":
        return F.when(extent >= size, fits).otherwise(F.array().cast("array<int>"))
    raise ValueError(f"unknown mode {mode}")


def tile_grid(images: DataFrame, key: str, height: str, width: str, size: int, stride: int, mode: str = "pad") -> DataFrame:
    """key, row, col, y0, x0: the tiles of each image. NULL or negative extents give none."""
    good = images.filter((F.col(height) > 0) & (F.col(width) > 0))
    rows = good.select(key, F.col(width).alias("__w"), F.posexplode(offsets(F.col(height).cast("int"), size, stride, mode)).alias("row", "y0"))
    return rows.select(key, "row", "y0", F.posexplode(offsets(F.col("__w").cast("int"), size, stride, mode)).alias("col", "x0"))


def percentile_bounds(values: DataFrame, by: Sequence[str], value: str, low: float = 0.02, high: float = 0.98, nodata: float | None = None) -> DataFrame:
    """by, lo, hi: exact percentiles with linear interpolation, ignoring NULL and values beyond `nodata`; NULL for a band without a value.

    Values are reduced to distinct ones with their counts and numbered by a distributed running total over (band, value), so no task holds a band; the
    two values around each percentile are then picked by their places.
    """
    v = F.col(value).cast("double")
    good = values.select(*by, v.alias("__v")).filter("__v is not null" + ("" if nodata is None else f" and __v <= {float(nodata)!r}"))
    counts = good.groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ranked = cut(running_total(counts, [*by, "__v"], "__n", "__before"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sizes = ranked.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("__n").alias("__all"), F.min("__before").alias("__start"))
    on = F.lit(True)
    for c in by:
        on = on & same(c, f"__{c}")
    placed = ranked.join(sizes, on).withColumn("__first", F.col("__before") - F.col("__start")).withColumn("__last", F.col("__first") + F.col("__n") - 1)

    def at(q: float) -> Column:
        """Sum over the band's values of their weight at the percentile: at most two have one."""
        place = F.lit(q) * (F.col("__all") - 1)
        lower, part = F.floor(place), place - F.floor(place)
        holds = lambda i: i.between(F.col("__first"), F.col("__last")).cast("double")
        return F.sum(F.col("__v") * (holds(lower) * (1 - part) + holds(lower + 1) * part))

    wanted = F.lit(False)
    for q in (low, high):
        lower = F.floor(F.lit(q) * (F.col("__all") - 1))
        wanted = wanted | ((F.col("__first") <= lower + 1) & (F.col("__last") >= lower))
    found = placed.filter(wanted).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], *[c for c in placed.columns if c.startswith("__")])
    found = found.groupBy(*[f"__b{i}" for i in range(len(by))]).agg(at(low).alias("lo"), at(high).alias("hi"))
    bands, on = values.select(*by).distinct(), F.lit(True)
    for i, c in enumerate(by):
        on = on & same(c, f"__b{i}")
    return bands.join(found, on, "left").select(*by, "lo", "hi")


def stretch(values: DataFrame, by: Sequence[str], value: str, nodata: float | None = None) -> DataFrame:
    """values with `scaled` in 0..255 between the 2nd and 98th percentile of its band."""
    bounds = percentile_bounds(values, by, value, nodata=nodata)
    v = F.col(value).cast("double")
    clean = F.when(v <= nodata, v) if nodata is not None else v
    return values.join(cut(bounds), list(by), "left").withColumn("scaled", stretched(clean, F.col("lo"), F.col("hi"))).drop("lo", "hi")


def tile_stats(pixels: DataFrame, by: Sequence[str], value: str, nodata: float | None = None) -> DataFrame:
    """by, n, n_valid, mean, greatest, zero_share, missing_share of the pixels of each tile."""
    v = F.col(value).cast("double")
    valid = v.isNotNull() & (~F.isnan(v)) & ((v <= nodata) if nodata is not None else F.lit(True))
    return pixels.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.avg(F.when(valid, v)).alias("mean"),
        F.max(F.when(valid, v)).alias("greatest"),
        F.avg(F.coalesce((v == 0).cast("double"), F.lit(0.0))).alias("zero_share"),
        F.avg((~valid).cast("double")).alias("missing_share"),
    )


def not_blank(stats: DataFrame, zero_limit: float = 0.6, missing_limit: float = 0.8) -> DataFrame:
    return stats.filter((F.col("zero_share") <= zero_limit) & (F.col("missing_share") <= missing_limit))


def largest_region(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(y0, x0, y1, x1), ends included, of the largest 8-connected region after closing gaps of up to 4 pixels.

    Outside the raster counts as empty when the mask grows and as full when it shrinks again.
    """
    if mask.size == 0 or not mask.any():
        return None

    def shifted(m: np.ndarray, k: int, fill: bool, combine) -> np.ndarray:  # noqa: ANN001
        padded = np.pad(m, k, constant_values=fill)
        out = m.copy()
        for dy in range(2 * k + 1):
            for dx in range(2 * k + 1):
                out = combine(out, padded[dy : dy + m.shape[0], dx : dx + m.shape[1]])
        return out

    closed = shifted(shifted(mask, 2, False, np.logical_or), 2, True, np.logical_and) | mask
    label = np.where(closed, np.arange(closed.size).reshape(closed.shape) + 1, 0)
    while True:  # greatest label spreads through each region
        spread = np.where(closed, shifted(label, 1, 0, np.maximum), 0)
        if (spread == label).all():
            break
        label = spread
    names, counts = np.unique(label[label > 0], return_counts=True)
    ys, xs = np.nonzero(label == names[np.argmax(counts)])
    return int(ys.min()), int(xs.min()), int(ys.max()), int(xs.max())


def building_boxes(rasters: DataFrame, key: str, heights: str, above: float = 2.0) -> DataFrame:
    """key, box [x0, y0, x1, y1]: bounding box of the largest region higher than `above`; NULL if there is none.

    heights: array of rows of pixel heights; one raster is one row, so each is handled where it lies. NULL pixels are
    low. Ragged rows are padded.
    """

    @F.pandas_udf("array<double>")
    def find(column: pd.Series) -> pd.Series:
        out = []
        for grid in column:
            if grid is None or not len(grid):
                out.append(None)
                continue
            width = max(len(r) if r is not None else 0 for r in grid)
            a = np.zeros((len(grid), width))
            for i, r in enumerate(grid):
                if r is not None and len(r):
                    a[i, : len(r)] = np.nan_to_num(np.array([0.0 if x is None else x for x in r], dtype=float))
            hit = largest_region(a > above)
            out.append(None if hit is None else [float(hit[1]), float(hit[0]), float(hit[3]), float(hit[2])])
        return pd.Series(out)

    return rasters.select(key, find(heights).alias("box"))


def best_box(found: DataFrame, key: str, images: DataFrame, width: str, height: str) -> DataFrame:
    """key, box: the detector's box of greatest score (ties: least box), else the middle third of the image."""
    top = found.groupBy(key).agg(F.max_by("box", F.struct("score", *[-F.coalesce(F.get("box", F.lit(i)), F.lit(0.0)) for i in range(4)])).alias("box"))
    w, h = F.col(width), F.col(height)
    middle = F.array(w / 3, h / 3, 2 * w / 3, 2 * h / 3)
    return images.join(top, key, "left").select(key, F.coalesce("box", middle).alias("box"))

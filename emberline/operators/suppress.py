"""Greedy suppression of overlapping boxes, exact for groups of any size.

A box is kept if no kept box of its group that ranks before it overlaps it by more than the threshold. Groups of up to
`most` boxes are decided by a vectorised pass over sorted partitions. Larger ones are decided in rounds without gathering them: overlapping
pairs come from a grid join, a box whose earlier neighbours are all decided is decided, and rounds go on until none is
left open. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.boxes import corner, iou, is_box
from emberline.operators.joins import covering
from emberline.session import cut


def kept(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy mask over boxes (n x 4, NaN rows overlap nothing) in rank order."""
    n = len(boxes)
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    keep = np.ones(n, dtype=bool)
    for i in range(n):
        if not keep[i] or np.isnan(boxes[i]).any():
            continue
        rest = np.flatnonzero(keep[i + 1 :]) + i + 1
        w = np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0])
        h = np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = area[i] + area[rest] - inter
        with np.errstate(divide="ignore", invalid="ignore"):
            over = np.where(union > 0, inter / union, 0.0)
        keep[rest[over > threshold]] = False
    return keep


def suppress(
    rows: DataFrame, group: Sequence[str], box: str, rank: Sequence[str], threshold: float = 0.5, most: int = 5000, cell: float = 64.0
) -> DataFrame:
    """Rows kept by greedy suppression within each group, in ascending order of the columns `rank`.

    rank must be total within a group for a defined result. Short, NULL or empty boxes overlap nothing and are kept. For score
    order pass a negated score. Columns named __* are reserved.
    """
    coords = F.when(is_box(F.col(box)), F.array(*[corner(F.col(box), i) for i in range(4)]))
    base = rows.withColumn("__box", coords)
    sizes = base.groupBy(*group).agg(F.count("*").alias("__n"))
    large = cut(sizes.filter(F.col("__n") > most).select(*group))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group]
    on = same[0]
    for c in same[1:]:
        on = on & c
    small_rows = base.alias("x").join(large.alias("y"), on, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            g, h = frame["__g"].to_numpy(), frame["__h"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
            if len(starts) > 1:
                yield mask(frame.iloc[: starts[-1]], starts[:-1])
            held = frame.iloc[starts[-1] :]  # the last group may go on in the next batch; it has at most `most` rows
        if held is not None and len(held):
            yield mask(held, np.array([0]))

    def mask(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        nothing = [np.nan] * 4
        boxes = np.array([nothing if b is None else list(b) for b in frame["__box"]], dtype=float).reshape(len(frame), 4)
        keep = np.ones(len(frame), dtype=bool)
        for a, z in zip(starts, [*starts[1:], len(frame)], strict=True):
            if z - a > 1:
                keep[a:z] = kept(boxes[a:z], threshold)
        return frame[keep]

    # groups lie together, in rank order, told apart by 128 bits of hash
    grouped = small_rows.withColumns({"__g": F.xxhash64(F.lit(1), *group), "__h": F.xxhash64(F.lit(2), *group)})
    sorted_rows = grouped.repartition(*group).sortWithinPartitions("__g", "__h", *rank)
    out = sorted_rows.mapInPandas(run, grouped.schema).drop("__g", "__h")
    if large.limit(1).count():
        out = out.unionByName(_in_rounds(base.alias("x").join(large.alias("y"), on, "left_semi"), group, rank, threshold, cell))
    return out.drop("__box")


def _in_rounds(rows: DataFrame, group: Sequence[str], rank: Sequence[str], threshold: float, cell: float) -> DataFrame:
    keyed = cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    boxes = keyed.filter("__box is not null").select(
        F.struct(*group).alias("g"), F.struct(F.struct(*rank, "__id").alias("r"), "__id", F.col("__box").alias("b")).alias("id"),
        *[corner(F.col("__box"), i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
    )
    # the earlier box and the later one that it would suppress
    pairs = covering(boxes, boxes, cell, ["g"]).filter(F.col("box_id.r") < F.col("cover_id.r")).filter(iou(F.col("box_id.b"), F.col("cover_id.b")) > threshold)
    edges = cut(pairs.select(F.col("box_id.__id").alias("a"), F.col("cover_id.__id").alias("z")))
    gone = edges.select(F.col("z").alias("id")).limit(0)
    while True:
        # kept: no open earlier neighbour; what they suppress goes, with all its edges
        open_late = edges.select(F.col("z").alias("id")).distinct()
        first = edges.select(F.col("a").alias("id")).distinct().join(open_late, "id", "left_anti")
        lost = edges.join(first, F.col("a") == F.col("id"), "left_semi").select(F.col("z").alias("id")).distinct()
        lost = cut(lost)
        if not lost.limit(1).count():
            break
        gone = cut(gone.unionByName(lost))
        edges = cut(edges.join(lost, F.col("a") == F.col("id"), "left_anti").join(lost, F.col("z") == F.col("id"), "left_anti"))
    return keyed.join(gone, F.col("__id") == F.col("id"), "left_anti").drop("__id")

"""Joins that Spark has no name for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.scan import running_total


def band_pairs(points: DataFrame, key: str, x: str, y: str, distance: float) -> DataFrame:
    """id_a < id_b: points at most `distance` apart.

    Points fall into square cells of that width; one side is copied to the 3 x 3 cells around, so an equality on the
    cell replaces the band condition and no cell meets more than its neighbours. NULL coordinates and keys leave.
    """
    if distance <= 0:
        raise ValueError("distance must be positive")
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.filter("id is not null and x is not null and y is not null")
    p = p.withColumn("cx", F.floor(F.col("x") / distance)).withColumn("cy", F.floor(F.col("y") / distance))
    around = p.select(
        F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy",
    ).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.select("id_b", "xb", "yb", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    near = p.join(around, ["cx", "cy"]).filter(F.col("id") < F.col("id_b"))
    dx, dy = F.col("x") - F.col("xb"), F.col("y") - F.col("yb")
    return near.filter(dx * dx + dy * dy <= distance * distance).select(F.col("id").alias("id_a"), "id_b")


def covering(boxes: DataFrame, tiles: DataFrame, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """by, box_id, cover_id: boxes and tiles (id, x0, y0, x1, y1, and the columns `by`) whose interiors overlap.

    A box is laid on the grid of the level whose cells (`cell` times a power of two) are no smaller than its longer side, so that it touches four
    of them at most however large it is. Boxes of two levels meet in the coarser one's grid: each side is copied to its own cells and the other to the
    cells it touches on the levels that occur there. A pair is kept only in the cell that holds the lower corner of its overlap, so
    nothing needs to be made distinct afterwards. Empty boxes and NULL coordinates leave.
    """

    def levelled(df: DataFrame) -> DataFrame:
        good = df.filter("x1 > x0 and y1 > y0")
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / cell
        return good.withColumn("__level", F.greatest(F.ceil(F.log2(side)), F.lit(0)).cast("int"))

    b, t = levelled(boxes), levelled(tiles)
    # at most some sixty levels occur, as sizes are doubles
    levels = sorted(r[0] for r in b.select("__level").unionByName(t.select("__level")).distinct().collect())
    listed = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")

    def celled(df: DataFrame, tag: str) -> DataFrame:
        at = df.select("*", F.explode(F.filter(listed, lambda x: x >= F.col("__level"))).alias("__grid"))
        width = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__grid"))
        span = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / F.col("__w")), F.floor(F.col(z) / F.col("__w"))))
        out = at.withColumn("__w", width).withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
        return out.select(*by, "__grid", "cx", "cy", *[F.col(c).alias(f"{tag}_{c}") for c in ("id", "x0", "y0", "x1", "y1", "__level", "__w")])

    pairs = celled(b, "b").join(celled(t, "t").drop("t___w"), [*by, "__grid", "cx", "cy"])
    over = pairs.filter("b_x0 < t_x1 and t_x0 < b_x1 and b_y0 < t_y1 and t_y0 < b_y1")
    own = F.greatest("b___level", "t___level") == F.col("__grid")
    home = (F.floor(F.greatest("b_x0", "t_x0") / F.col("b___w")) == F.col("cx")) & (F.floor(F.greatest("b_y0", "t_y0") / F.col("b___w")) == F.col("cy"))
    return over.filter(own & home).select(*by, F.col("b_id").alias("box_id"), F.col("t_id").alias("cover_id"))


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows whose key is not done yet."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def with_default(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join that fills the named columns where the right side has no row (or holds NULL)."""
    out = left.join(right, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_k(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, into: str = "rn") -> DataFrame:
    """The first k rows of each group with their number; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(into, F.row_number().over(w)).filter(F.col(into) <= k)


def capped_cross(left: DataFrame, right: DataFrame, key: str, a: str, b: str, k: int, missing: str = "—") -> DataFrame:
    """key, a, b: the first k of each side per key crossed with each other; a side without rows gives `missing`."""
    x = first_k(left.select(key, a).distinct(), [key], [a], k).select(key, a)
    y = first_k(right.select(key, b).distinct(), [key], [b], k).select(key, b)
    return x.join(y, key, "full").select(key, F.coalesce(a, F.lit(missing)).alias(a), F.coalesce(b, F.lit(missing)).alias(b))


def surrogate_ids(rows: DataFrame, order: Sequence[str], into: str = "new_id", start: int = 1) -> DataFrame:
    """Dense ids start..n in the order given, which must be total, without gathering the rows in one task."""
    one = rows.withColumn("__one", F.lit(1))
    return running_total(one, list(order), "__one", into).withColumn(into, F.col(into) + start).drop("__one")


def remapped(rows: DataFrame, ids: DataFrame, keys: Sequence[str], new: str = "new_id") -> DataFrame:
    """rows with the surrogate key of their owner; rows whose owner is unknown leave."""
    return rows.join(ids.select(*keys, new), list(keys))


def snapped_cells(points: DataFrame, x: str, y: str, size: float, columns: int, rows: int) -> DataFrame:
    """Points with every cell (column * rows + row) of a grid from 0 whose closed box holds them: those on an edge lie in two, on a corner in four.

    The cells come from the coordinates; points outside the grid and NULL coordinates leave.
    """

    def at(c: str, many: int) -> Column:
        v = F.floor(F.col(c) / size)
        both = F.when(F.col(c) == v * size, F.array(v - 1, v)).otherwise(F.array(v))
        return F.filter(both, lambda i: (i >= 0) & (i < many))

    held = points.select("*", F.explode(at(x, columns)).alias("__i"))
    return held.select("*", F.explode(at(y, rows)).alias("__j")).withColumn("cell", (F.col("__i") * rows + F.col("__j")).cast("long")).drop("__i", "__j")

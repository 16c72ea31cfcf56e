"""Counts, profiles, agreement and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.joins import surrogate_ids


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole rounded half up, 0 where the whole is 0."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), places)


def pivot_counts(rows: DataFrame, by: str, column: str, values: Sequence[str], total: str = "total") -> DataFrame:
    """Per `by` the count of each of the fixed values (0 where there is none), and of all rows; one aggregation."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return rows.groupBy(by).agg(*counts, F.count("*").alias(total))


def detection_profile(rows: DataFrame, by: str, flag: Column, group: str) -> DataFrame:
    """by, n, flagged, flagged_pct (one place), n_groups."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(flag).alias("flagged"),
        F.round(100 * F.avg(F.coalesce(flag, F.lit(False)).cast("double")), 1).alias("flagged_pct"),
        F.countDistinct(group).alias("n_groups"),
    )


def agreement(a: DataFrame, b: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """key, label_a, label_b, span: keys present on both sides and how many steps their labels lie apart."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c)).cast("int")
    both = a.select(key, F.col(label).alias("label_a")).join(b.select(key, F.col(label).alias("label_b")), key)
    return both.withColumn("span", F.abs(rank("label_a") - rank("label_b")))


def agreement_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n_both"), F.count_if(F.col("label_a") == F.col("label_b")).alias("n_agree"),
        share(F.count_if(F.col("label_a") == F.col("label_b")).cast("double"), F.count("*")).alias("agree_rate"),
    )


def ablation(tiles: DataFrame, arm: str, detections: str, marker: Column) -> DataFrame:
    """Per arm: n_tiles, n_detections, per_tile, n_cited, cited_rate. tiles: one row per tile with its detection array."""
    n = F.size(F.coalesce(F.col(detections), F.array()))
    return tiles.groupBy(arm).agg(
        F.count("*").alias("n_tiles"), F.sum(n).alias("n_detections"),
        share(F.sum(n).cast("double"), F.count("*")).alias("per_tile"),
        F.sum(marker).alias("n_cited"), share(F.sum(marker).cast("double"), F.sum(n)).alias("cited_rate"),
    )


def level_histogram(rows: DataFrame, value: str, levels: Sequence[float], tolerance: float = 0.05, weight: str | None = None) -> DataFrame:
    """level, n, pct: rows whose value lies within the tolerance of a level (first hit); others count as NULL. weight: a column of counts."""
    out: Column | None = None
    for v in levels:
        hit = F.abs(F.col(value) - v) < tolerance
        out = F.when(hit, float(v)) if out is None else out.when(hit, float(v))
    n = rows.groupBy(out.alias("level")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    # one row per level
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def checklist(items: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """item, n_rows, present: one row per named input."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("item"), "n_rows", (F.col("n_rows") > 0).alias("present")) for name, df in items]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """rows with line_no 1..n in ascending order of the keys (negate a number for descending); repeats may stand either way round."""
    names = []
    for i, o in enumerate(order):
        rows = rows.withColumn(f"__o{i}", F.col(o) if isinstance(o, str) else o)
        names.append(f"__o{i}")
    return surrogate_ids(rows, names, "line_no").drop(*names)


def text_lines(rows: DataFrame, columns: Sequence[tuple[str, int]], order: Sequence[str | Column]) -> DataFrame:
    """line_no, line: fixed-width lines in ascending order of the columns `order`; a width below 0 aligns right."""
    cell = lambda c, w: F.lpad(F.col(c).cast("string"), -w, " ") if w < 0 else F.rpad(F.col(c).cast("string"), w, " ")
    return _numbered(rows, order).select("line_no", F.concat_ws(" ", *[F.coalesce(cell(c, w), F.lit("")) for c, w in columns]).alias("line"))


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """line_no, line: a table of Markdown with its header, in ascending order of the columns `order`."""
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "line_no long, line string")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return head.unionByName(_numbered(rows, order).select("line_no", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))

"""Vectors as arrays: norms, cosine, softmax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PROMPTS = 5000


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; NULL if the lengths differ or an element is NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """v over its Euclidean norm; zero vectors stay zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def two_way_softmax(first: Column, second: Column) -> Column:
    """Share of the second of two logits, stable for large ones."""
    top = F.greatest(first, second)
    return F.exp(second - top) / (F.exp(first - top) + F.exp(second - top))


def prompt_scores(rows: DataFrame, key: str, vector: str, prompts: DataFrame, klass: str, prompt_vector: str) -> DataFrame:
    """key, class, score: the greatest cosine over each class's prompts.

    prompts is a set of at most MAX_PROMPTS unit vectors (checked), laid beside each row as a literal: every row needs
    every class, and the maximum over a class's prompts is taken inside the row, so nothing is joined or shuffled.
    """
    listed = prompts.select(F.col(klass).alias("c"), F.col(prompt_vector).cast("array<double>").alias("v")).limit(MAX_PROMPTS + 1).collect()
    if len(listed) > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} prompts")
    by_class: dict[object, list[list[float]]] = {}
    for r in listed:
        by_class.setdefault(r["c"], []).append(list(r["v"]))
    names = sorted(by_class)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([np.array(by_class[c]) for c in names])  # bounded above

    @F.pandas_udf("array<double>")
    def best(column: pd.Series) -> pd.Series:
        known = np.array([v is not None for v in column], dtype=bool)
        out = np.full((len(column), len(names)), np.nan)
        if known.any():
            x = np.vstack([np.asarray(v, dtype=float) for v in column[known]])
            for j, p in enumerate(shared.value):
                out[known, j] = (x @ p.T).max(axis=1)
        return pd.Series([row if ok else None for row, ok in zip(out, known, strict=True)])

    kind = prompts.schema[klass].dataType
    scored = rows.select(key, F.posexplode(best(F.col(vector))).alias("i", "score"))
    return scored.select(key, F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).cast(kind).alias("class"), "score")


def top_string(scores: DataFrame, key: str, k: int = 5, form: str = "%s=%.3f") -> DataFrame:
    """key, top: the k best classes as "class=0.123, ..."; ties go to the alphabetically first class."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "class")
    best = scores.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    text = F.struct(F.col("__rn").alias("rn"), F.format_string(form, "class", "score").alias("text"))
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(text)).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["text"]), ", ").alias("top"))

"""Samples that any engine can repeat: rows are ranked by the MD5 of key and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.scan import running_total
from emberline.session import cut


def lot(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def k_per_stratum(rows: DataFrame, strata: Sequence[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each stratum; each stratum is cut to k before the shuffle."""
    w = Window.partitionBy(*strata).orderBy("__lot", key)
    out = rows.withColumn("__lot", lot(F.col(key), seed)).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    return out.drop("__lot", "__rn")


def padded_sample(rows: DataFrame, strata: Sequence[str], key: str, k: int, total: int, seed: int = 42) -> DataFrame:
    """k rows of each stratum, filled up from the rest to `total` rows, cut to `total` if there are more. key is unique.

    Both parts are top-k: each stratum is cut to k before the shuffle, and of the rest only the `total` least lots can be needed.
    """
    drawn = rows.withColumn("__lot", lot(F.col(key), seed))
    first = cut(k_per_stratum(rows, strata, key, k, seed).withColumn("__lot", lot(F.col(key), seed)).withColumn("__late", F.lit(0)))
    # the first `total` of all lots, and as many again as were drawn already, hold the filling
    many = total + min(first.count(), total)
    rest = drawn.orderBy("__lot", key).limit(many).join(first.select(key), key, "left_anti").withColumn("__late", F.lit(1))
    return first.unionByName(rest).orderBy("__late", "__lot", key).limit(total).drop("__late", "__lot")


def exact_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, floor(n * fraction)) rows without replacement; ranks come from a distributed running count."""
    ranked = running_total(rows.withColumn("__lot", lot(F.col(key), seed)).withColumn("__one", F.lit(1)), ["__lot", key], "__one", "__rank")
    n = ranked.agg(F.count("*").alias("n")).first()["n"]
    return ranked.filter(F.col("__rank") < max(1, int(n * fraction))).drop("__lot", "__one", "__rank")

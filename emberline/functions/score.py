"""Weighted scores, bands and ordered labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import mapped

# Weights and bands of the zone score.
ZONE_WEIGHT = {"Zone_0": 3, "Zone_1": 2, "Zone_2": 1}
SEVERITY_WEIGHT = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0, "NONE": 0}
SCORE_BANDS = ((0, "LOW"), (4, "MEDIUM"), (9, "HIGH"))
# Order of risk labels.
RISK_ORDER = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def band(score: Column, bands: Sequence[tuple[float, str]] = SCORE_BANDS, above: str = "CRITICAL") -> Column:
    """Label of the first upper bound that the score does not exceed; NULL counts as 0."""
    score = F.coalesce(score, F.lit(0))
    out: Column | None = None
    for most, label in bands:
        out = F.when(score <= most, label) if out is None else out.when(score <= most, label)
    return F.lit(above) if out is None else out.otherwise(above)


def zone_score(rows: DataFrame, key: str, status: str, zone: str, severity: str, klass: str, violation: str = "VIOLATION") -> DataFrame:
    """Per key: score = sum of zone weight x severity weight over violations, label, violation_count, n_classes.

    Unknown zones and severities weigh 1; a missing zone counts as the outermost and a missing severity as NONE. Keys
    whose rows hold no violation score 0. One aggregation with map-side combine.
    """
    hit = F.coalesce(F.col(status) == violation, F.lit(False))
    zw = mapped(F.coalesce(F.col(zone), F.lit("Zone_2")), ZONE_WEIGHT, 1)
    sw = mapped(F.coalesce(F.col(severity), F.lit("NONE")), SEVERITY_WEIGHT, 1)
    out = rows.groupBy(key).agg(
        F.sum(F.when(hit, zw * sw).otherwise(0)).cast("long").alias("score"),
        F.count_if(hit).alias("violation_count"),
        F.countDistinct(F.when(hit, F.coalesce(F.col(klass), F.lit("unknown")))).alias("n_classes"),
    )
    return out.withColumn("risk_label", band(F.col("score")))


def breakdown(rows: DataFrame, key: str, klass: str) -> DataFrame:
    """key -> map from class to count, of the rows given."""
    n = rows.groupBy(key, F.coalesce(F.col(klass), F.lit("unknown")).alias("c")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("breakdown"))


def tally_score(rows: DataFrame, key: str, status: str, severity: str, risk: str, violation: str = "VIOLATION") -> DataFrame:
    """Per key: score = violations + 2 per critical + 1 per high one; label = the greatest risk label of its rows.

    Labels outside the order count as the lowest; keys without any label get NONE.
    """
    hit = F.coalesce(F.col(status) == violation, F.lit(False))
    critical, high = hit & F.coalesce(F.col(severity) == "CRITICAL", F.lit(False)), hit & F.coalesce(F.col(severity) == "HIGH", F.lit(False))
    out = rows.groupBy(key).agg(
        (F.count_if(hit) + 2 * F.count_if(critical) + F.count_if(high)).alias("score"),
        F.count_if(hit).alias("violation_count"),
        F.coalesce(F.max(mapped(F.col(risk), RISK_ORDER, 0)), F.lit(0)).alias("rank"),
    )
    names = F.array(*[F.lit(k) for k, _ in sorted(RISK_ORDER.items(), key=lambda kv: kv[1])])
    return out.withColumn("risk_label", F.element_at(names, F.col("rank") + 1)).drop("rank")


def worst(label: str, order: Mapping[str, int]) -> Column:
    """Aggregate: the label with the greatest rank; labels of equal rank go to the alphabetically last."""
    rank = mapped(F.col(label), dict(order), -1)
    return F.max_by(F.col(label), F.struct(rank, F.col(label)))

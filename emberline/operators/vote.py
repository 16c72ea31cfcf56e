"""Self-consistency vote over several answers per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order of confidences.
CONFIDENCE = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def vote(answers: DataFrame, tile: str, responses: str) -> DataFrame:
    """One row per tile and class, voted over its answers.

    answers: tile, `responses` (how many answers the tile has), resp (0..), det (position in the answer), object_class,
    compliance_status, severity, confidence. Per answer the first detection of a class counts; an answer without the
    class counts as UNCERTAIN / NONE / LOW. Status and severity are the plurality, ties going to the one seen in the
    earlier answer; confidence is the least. If all of several statuses differ the result is UNCERTAIN, LOW, flagged.
    first_resp tells whose box and trace to take. all_agree means that nothing of the tile is flagged. Only counts are
    joined and no answer list is gathered; the answers without a class are one row with their number, so tiles of many
    answers take no more rows than they have detections. Rows with a NULL class leave.
    """
    by = [tile, "object_class"]
    rank = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    # one shuffle: all that follows up to all_agree is partitioned by tile and class or finer
    rows = answers.filter("object_class is not null").repartition(tile, "object_class")
    one = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "resp").orderBy("det"))).filter("__rn = 1")
    # answers are numbered from 0, so as many as equal their place come before the first that lacks the class
    one = one.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy("resp")) - 1)
    kinds = one.groupBy(
        *by, F.col(responses), F.coalesce("compliance_status", F.lit("UNCERTAIN")).alias("__s"), F.coalesce("severity", F.lit("NONE")).alias("__v"),
        F.coalesce(F.try_element_at(rank, F.coalesce("confidence", F.lit("LOW"))), F.lit(0)).alias("__c"),
    ).agg(F.count("*").alias("__n"), F.min("resp").alias("__at"), F.count_if(F.col("resp") == F.col("__place")).alias("__run"))
    own = Window.partitionBy(*by)
    kinds = kinds.select(
        "*", (F.col(responses) - F.sum("__n").over(own)).alias("__lacking"), F.sum("__run").over(own).alias("__gap"), F.min("__at").over(own).alias("first_resp")
    )
    voice = lambda s, v, c, n, at: F.struct(s.alias("__s"), v.alias("__v"), c.alias("__c"), n.cast("long").alias("__n"), at.cast("long").alias("__at"))
    present = voice(*map(F.col, ("__s", "__v", "__c", "__n", "__at")))
    absent = voice(F.lit("UNCERTAIN"), F.lit("NONE"), F.lit(0), F.col("__lacking"), F.col("__gap"))
    both = F.when((F.col("__at") == F.col("first_resp")) & (F.col("__lacking") > 0), F.array(present, absent)).otherwise(F.array(present))
    full = kinds.select(*by, responses, "first_resp", F.inline(both))
    for c in ("s", "v"):
        same = Window.partitionBy(*by, f"__{c}")
        full = full.withColumn(f"__n_{c}", F.sum("__n").over(same)).withColumn(f"__at_{c}", F.min("__at").over(same))
    names = F.array(*map(F.lit, CONFIDENCE))
    out = full.groupBy(*by, responses, "first_resp").agg(
        F.max_by("__s", F.struct("__n_s", -F.col("__at_s"))).alias("status"), F.max_by("__v", F.struct("__n_v", -F.col("__at_v"))).alias("severity"),
        F.count_if(F.col("__at") == F.col("__at_s")).alias("status_kinds"), F.min("__c").alias("least"),
    )
    flagged = (F.col("status_kinds") == F.col(responses)) & (F.col(responses) > 1)
    out = out.withColumn("flagged", flagged)
    return out.select(
        tile, "object_class", "first_resp",
        F.when(F.col("flagged"), "UNCERTAIN").otherwise(F.col("status")).alias("compliance_status"),
        "severity",
        F.when(F.col("flagged"), "LOW").otherwise(F.element_at(names, F.col("least") + 1)).alias("confidence"),
        "flagged",
        (F.max(F.col("flagged").cast("int")).over(Window.partitionBy(tile)) == 0).alias("all_agree"),
    )


def first_success(attempts: DataFrame, key: str, attempt: str, ok: str) -> DataFrame:
    """Per key the first attempt that succeeded, else the last one made."""
    rest = [c for c in attempts.columns if c != key]
    best = F.struct(F.coalesce(F.col(ok), F.lit(False)), F.when(F.col(ok), -F.col(attempt)).otherwise(F.col(attempt)))
    picked = attempts.groupBy(key).agg(F.max_by(F.struct(*rest), best).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])

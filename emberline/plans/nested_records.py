"""Queries over raw chip records, flattened into related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import nested
from emberline.plans.tables import table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nodes(table(spark, sf, "vlm_raw_records").select("record_id", "payload"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every violation with the positions on its path."""
    placed = nested.with_ancestors(_nodes(spark, sf).drop("attributes"), ("object", "detection"))
    return placed.filter("node_type = 'violation'").select(
        "record_id", "object_no", "detection_no", F.col("array_no").alias("violation_no"), F.col("label").alias("violation_id")
    )


def p3_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All entities with their interval labels."""
    return _nodes(spark, sf)


def p3_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with the parcel of their record and the number of violations inside, by interval containment."""
    node = _nodes(spark, sf)
    pick = lambda t: nested.of_type(node, t).drop("attributes")
    inside = pick("object").alias("o").join(pick("violation").alias("v"), nested.contains("o", "v"), "left")
    counted = inside.groupBy("o.record_id", "o.pre", "o.array_no", "o.label").agg(F.count("v.pre").alias("n_violations"))
    records = pick("record").select("record_id", F.col("label").alias("parcel_id"))
    return counted.join(records, "record_id").select(
        "record_id", "parcel_id", F.col("array_no").alias("object_no"), F.col("label").alias("object_class"), "n_violations"
    )


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p3_objects": p3_objects}

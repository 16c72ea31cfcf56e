"""A model run over tiles, composed of the operators: resume, order, retry, parse, vote on doubt, deduplicate, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import boxes, score, text
from emberline.operators import joins, model, suppress, vote
from emberline.session import cut

ANSWER = "struct<detections: array<struct<object_class: string, bounding_box_pixels: array<double>, zone: string, compliance_status: string, confidence: string, severity: string, cot_trace: string>>>"


def ask(tiles: DataFrame, factory: Callable[[], model.Model], key: str, attempts: int = 1, width: int | None = None) -> DataFrame:
    """One row per tile and attempt: key, attempt, detections, parse_failed, error."""
    tries = tiles.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    answered = model.run_model(tries, factory, "answer", width)
    parsed = F.from_json(text.recovered_json(F.col("answer")), ANSWER)
    return answered.select(key, "attempt", parsed["detections"].alias("detections"), parsed["detections"].isNull().alias("parse_failed"), "error")


def tile_run(
    planned: DataFrame, done: DataFrame, factory: Callable[[], model.Model], votes: int = 3, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(detections per tile, scores per parcel) of the planned tiles that are not done.

    planned: tile_id, parcel_id, x0, y0 (place of the tile in its image) and whatever the model needs; done: tile_id.
    A tile whose first answer cannot be parsed is asked once more; tiles of which a detection has LOW confidence are asked
    `votes` times and voted over (votes = 0: never). Boxes move to image coordinates before the parcel's overlapping ones are dropped. Each stage is
    written once, so a model is never called again for a later one. Tiles that fail twice give no row.
    """
    todo = cut(joins.pending(planned, done, ["tile_id"]))
    first = cut(ask(todo, factory, "tile_id", width=width))
    failed = first.filter("parse_failed").select("tile_id")
    again = ask(todo.join(failed, "tile_id", "left_semi"), factory, "tile_id", width=width).withColumn("attempt", F.lit(1))
    best = cut(vote.first_success(first.unionByName(again).withColumn("ok", ~F.col("parse_failed")), "tile_id", "attempt", "ok"))
    flat = best.select("tile_id", F.posexplode("detections").alias("det_no", "d")).select("tile_id", "det_no", "d.*")
    doubtful = F.coalesce(F.col("confidence"), F.lit("LOW")) == "LOW"
    columns = ["tile_id", "det_no", "object_class", "bounding_box_pixels", "zone", "compliance_status", "confidence", "severity"]
    if votes:
        low = cut(flat.filter(doubtful).select("tile_id").distinct())
        more = cut(ask(todo.join(low, "tile_id", "left_semi"), factory, "tile_id", votes, width))
        each = more.select("tile_id", F.lit(votes).alias("n"), F.col("attempt").alias("resp"), F.posexplode("detections").alias("det", "d"))
        each = each.select("tile_id", "n", "resp", "det", "d.*")
        voted = vote.vote(each.drop("cot_trace", "bounding_box_pixels", "zone"), "tile_id", "n")
        shape = each.groupBy("tile_id", "object_class", F.col("resp").alias("first_resp")).agg(
            F.min_by(F.struct("det", "bounding_box_pixels", "zone"), "det").alias("s")
        )
        settled = voted.join(shape, ["tile_id", "object_class", "first_resp"]).select(
            "tile_id", F.col("s.det").alias("det_no"), "object_class", F.col("s.bounding_box_pixels").alias("bounding_box_pixels"), F.col("s.zone").alias("zone"),
            "compliance_status", "confidence", "severity",
        )
        flat = flat.join(low, "tile_id", "left_anti").select(*columns).unionByName(settled)
    found = cut(flat.select(*columns).join(todo.select("tile_id", "parcel_id", "x0", "y0"), "tile_id"))
    placed = found.withColumn("box", boxes.translate(F.col("bounding_box_pixels"), F.col("x0").cast("double"), F.col("y0").cast("double")))
    placed = placed.withColumn("rank", -text.mapped(F.col("confidence"), {"LOW": 0, "MEDIUM": 1, "HIGH": 2}, 0))
    kept = suppress.suppress(placed, ["parcel_id"], "box", ["rank", "tile_id", "det_no", "object_class"])
    return found, score.zone_score(kept, "parcel_id", "compliance_status", "zone", "severity", "object_class")

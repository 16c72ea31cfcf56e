from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import prompts
from emberline.functions.records import defaults, merged_maps, tagged
from emberline.operators import runs


def factory():
    def answer(items):
        out = []
        for x in items:
            d = {"object_class": "vehicle", "bounding_box_pixels": [0, 0, 10, 10], "zone": "Zone_0", "compliance_status": "VIOLATION", "severity": "HIGH"}
            if x["tile_id"] == 1:
                out.append({"detections": [d | {"confidence": "HIGH"}]})
            elif x["tile_id"] == 2:  # doubtful: asked again, answers differ
                out.append({"detections": [d | {"confidence": "LOW", "compliance_status": ("VIOLATION", "COMPLIANT")[x["attempt"] % 2]}]})
            elif x["tile_id"] == 3:
                raise RuntimeError("down")
            else:  # overlaps tile 1 in the image
                out.append({"detections": [d | {"confidence": "MEDIUM"}]})
        return out

    return answer


def test_tile_run(spark):
    planned = spark.createDataFrame([(1, "p", 0, 0), (2, "p", 500, 0), (3, "q", 0, 0), (4, "p", 1, 0), (9, "p", 0, 0)], "tile_id int, parcel_id string, x0 int, y0 int")
    done = spark.createDataFrame([(9,)], "tile_id int")
    found, scores = runs.tile_run(planned, done, factory, votes=2)
    got = {r["tile_id"]: (r["compliance_status"], r["confidence"]) for r in found.collect()}
    assert got == {1: ("VIOLATION", "HIGH"), 2: ("UNCERTAIN", "LOW"), 4: ("VIOLATION", "MEDIUM")}
    assert [(r["parcel_id"], r["score"], r["violation_count"]) for r in scores.collect()] == [("p", 6, 1)]
    nothing, _ = runs.tile_run(planned.limit(0), done, factory)
    assert nothing.count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("role", "ctx", ["a", "b"], "q", True), ("role", None, None, "q", True), ("role", "ctx", ["a"], "q", False)], "r string, c string, s array<string>, q string, g boolean")
    got = [r[0] for r in df.select(prompts.tile_prompt(*[F.col(c) for c in "rcsqg"])).collect()]
    assert got == ["role\n\nctx\n\nExample 1:\na\n\nExample 2:\nb\n\nq", "role\n\nq", "role\n\nq"]


def test_maps_and_elements(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"x": 1}), ({"x": 1}, None), (None, None)], "m map<string, int>, n map<string, int>")
    assert [r[0] for r in df.select(merged_maps(F.col("m"), F.col("n"))).collect()] == [{"a": 1, "b": 3}, {"x": 1}, {"x": 1}, None]
    df = spark.createDataFrame([([("v", None), None],), (None,)], "d array<struct<c: string, t: string>>")
    out = [r[0] for r in df.select(tagged(F.col("d"), "t", "aerial")).collect()]
    assert out[0][0]["t"] == "aerial" and out[0][1] is None and out[1] is None
    assert df.select(defaults(F.col("d"), {"t": "z"})).first()[0][0]["t"] == "z"

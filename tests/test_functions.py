"""Micro-fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from emberline.functions import boxes, score, text, vectors
from emberline.functions.records import effective_list, one_row_each
from emberline.operators import graph, raster, report
from emberline.plans.detections import ALIASES
from emberline.plans.texts import CATEGORIES, SCOPES


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


DET = "key string, status string, klass string, zone string, severity string"


def test_zone_score(spark):
    rows = [("a", "VIOLATION", "propane_tank", "Zone_0", "CRITICAL"), ("a", "VIOLATION", "vehicle", "Zone_1", "HIGH"), ("a", "COMPLIANT", "vehicle", "Zone_0", "CRITICAL"),
            ("b", "VIOLATION", "x", None, "REVIEW"), ("c", None, None, None, None)]
    out = {r["key"]: r for r in score.zone_score(spark.createDataFrame(rows, DET), "key", "status", "zone", "severity", "klass").collect()}
    assert (out["a"]["score"], out["a"]["risk_label"], out["a"]["violation_count"], out["a"]["n_classes"]) == (13, "CRITICAL", 2, 2)
    assert (out["b"]["score"], out["b"]["risk_label"], out["b"]["violation_count"]) == (1, "MEDIUM", 1)
    assert (out["c"]["score"], out["c"]["risk_label"], out["c"]["n_classes"]) == (0, "LOW", 0)
    hits = spark.createDataFrame(rows[:2], DET)
    assert score.breakdown(hits, "key", "klass").first()["breakdown"] == {"propane_tank": 1, "vehicle": 1}


def test_tally_score(spark):
    rows = [("p", "VIOLATION", "CRITICAL", "LOW"), ("p", "VIOLATION", "HIGH", "HIGH"), ("p", "VIOLATION", "MEDIUM", None), ("q", None, None, None)]
    df = spark.createDataFrame(rows, "key string, status string, severity string, risk string")
    out = {r["key"]: r for r in score.tally_score(df, "key", "status", "severity", "risk").collect()}
    assert (out["p"]["score"], out["p"]["risk_label"]) == (6, "HIGH")
    assert (out["q"]["score"], out["q"]["risk_label"]) == (0, "NONE")


@pytest.mark.parametrize(("t", "zone"), [("within 50 feet", "Zone_0"), ("5 to 30 feet", "Zone_1"), ("30 feet", "ALL"), ("100-foot", "Zone_2"), ("", "ALL"), (None, "ALL")])
def test_scope(spark, t, zone):
    assert one(spark, text.first_pattern(F.lit(t).cast("string"), SCOPES, "ALL")) == zone


def test_mentions_are_substrings(spark):
    vocabulary = {"car": ("car",), "hot_tub": ("hot tub", "spa"), "pergola": ("pergola", "carport")}
    assert one(spark, text.mentions(F.lit("carport spacing"), vocabulary)) == ["car", "hot_tub", "pergola"]
    assert not one(spark, text.contains_any(F.lit("carport spacing"), ("car", "spa"), whole_words=True))
    assert one(spark, text.mentions(F.lit(None).cast("string"), vocabulary)) == []


@pytest.mark.parametrize(("t", "grade"), [("a propane tank", 1.0), ("the LPG unit", 0.8), ("flammable items", 0.6), ("door", 0.4), (None, 0.4)])
def test_graded_match(spark, t, grade):
    assert one(spark, text.graded_match(F.lit(t).cast("string"), F.lit("propane_tank"), F.array(F.lit("lpg")), CATEGORIES)) == grade


@pytest.mark.parametrize(("label", "name"), [("car", "vehicle"), ("bbq tank", "propane_tank"), ("log pile", "wood_pile"), ("unknown_obj", "unknown_obj"), ("Trash_Can", "trash_can"), (None, None), ("", "")])
def test_alias(spark, label, name):
    df = spark.createDataFrame([(label,)], "l string")
    assert graph.resolve_alias(df, "l", ALIASES).first()["canonical"] == name


def test_iou(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, boxes.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(1 / 7)
    empty = F.array().cast("array<double>")
    assert one(spark, boxes.iou(empty, box(0, 0, 1, 1))) == 0
    assert one(spark, boxes.iou(F.lit(None).cast("array<double>"), box(0, 0, 1, 1))) == 0
    assert one(spark, boxes.iou(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0)), box(0, 0, 1, 1))) == 0
    assert one(spark, boxes.iou(box(1, 1, 1, 1), box(1, 1, 1, 1))) == 0
    assert one(spark, boxes.translate(empty, F.lit(1.0), F.lit(1.0))) is None


def test_grids(spark):
    grid = lambda mode: one(spark, raster.offsets(F.lit(1200), 512, 256, mode))
    assert (grid("pad"), grid("snap"), grid("drop")) == ([0, 256, 512], [0, 256, 512, 688], [0, 256, 512])
    small = lambda mode: one(spark, raster.offsets(F.lit(100), 512, 256, mode))
    assert (small("pad"), small("snap"), small("drop")) == ([0], [0], [])


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("a", 9e38), ("b", None)], "band string, v double")
    out = {r["band"]: r for r in raster.percentile_bounds(df, ["band"], "v", nodata=3.4e38).collect()}
    assert (out["a"]["lo"], out["a"]["hi"]) == (pytest.approx(1.06), pytest.approx(9.58))
    assert out["b"]["lo"] is None
    scaled = {(r["band"], r["v"]): r["scaled"] for r in raster.stretch(df, ["band"], "v", nodata=3.4e38).collect()}
    assert scaled["a", 1.0] == 0 and scaled["a", 10.0] == 255 and scaled["b", None] is None


@pytest.mark.parametrize(("raw", "ok"), [('```json\n{"a":1}\n```', True), ('x {"a":1} y', True), ('{"a":', False), ("[ERROR] e", False), (None, False), ("", False)])
def test_recover_json(spark, raw, ok):
    got = one(spark, text.recovered_json(F.lit(raw).cast("string")))
    assert (got is not None) == ok
    if ok:
        assert one(spark, F.get_json_object(F.lit(got), "$.a")) == "1"


def test_effective_list(spark):
    ddl = "id int, result struct<detections: array<string>>, detections array<string>"
    df = spark.createDataFrame([(1, ([],), ["d"]), (2, (["n"],), ["d"]), (3, None, None), (4, (None,), None), (5, ([],), None)], ddl)
    out = {r["id"]: r["d"] for r in df.select("id", effective_list().alias("d")).collect()}
    assert out[1] == ["d"] and out[2] == ["n"] and not out[3] and not out[4] and out[5] == []


def test_one_row_each(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "x")], "k int, v string")
    assert sorted(tuple(r) for r in one_row_each(df, "k").collect()) == [(1, "a"), (2, None)]


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.unit(v)) == [0.6, 0.8]
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vectors.two_way_softmax(F.lit(1000.0), F.lit(1000.0))) == 0.5
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, v array<double>")
    prompts = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.6, 0.8])], "c string, p array<double>")
    got = {(r["id"], r["class"]): r["score"] for r in vectors.prompt_scores(rows, "id", "v", prompts, "c", "p").collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.6}
    tied = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "id int, class string, score double")
    assert vectors.top_string(tied, "id", 2).first()["top"] == "c=0.900, a=0.500"


def test_html(spark):
    page = "<html><script>var a='</p>';</script><body><p>Fish &amp; chips</p><p>now</p></body></html>"
    from emberline.sources.readers import html_text

    assert one(spark, text.plain_html(F.lit(page))) == "Fish & chips now"
    assert one(spark, html_text(F.lit(page))) == "Fish & chips\nnow"
    assert one(spark, html_text(F.lit(None).cast("string"))) is None


def test_region():
    import numpy as np

    m = np.zeros((20, 30), dtype=bool)
    m[2:6, 3:9] = True
    m[9:16, 12:20] = True
    assert raster.largest_region(m) == (9, 12, 15, 19)
    assert raster.largest_region(np.zeros((3, 3), dtype=bool)) is None


def test_building_boxes(spark):
    df = spark.createDataFrame([(1, [[0.0, 5.0, 5.0], [0.0, 5.0]]), (2, [[0.0]]), (3, None), (4, [])], "id int, h array<array<double>>")
    got = {r["id"]: r["box"] for r in raster.building_boxes(df, "id", "h").collect()}
    assert got == {1: [0.0, 0.0, 2.0, 1.0], 2: None, 3: None, 4: None}


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.81), ("b", 1.0), ("c", None), ("d", 5.0)], "k string, v double")
    got = {r["level"]: r["n"] for r in report.level_histogram(df, "v", (1.0, 0.8)).collect()}
    assert got == {0.8: 1, 1.0: 1, None: 2}
    a = spark.createDataFrame([("p", "LOW"), ("q", "HIGH"), ("r", None)], "k string, l string")
    b = spark.createDataFrame([("p", "LOW"), ("q", "LOW"), ("z", "LOW")], "k string, l string")
    rate = report.agreement_rate(report.agreement(a, b, "k", "l", ("LOW", "MEDIUM", "HIGH"))).first()
    assert (rate["n_both"], rate["n_agree"], rate["agree_rate"]) == (2, 1, 0.5)
    assert report.agreement_rate(report.agreement(a.limit(0), b, "k", "l", ("LOW",))).first()["agree_rate"] == 0


def test_best_box_and_height(spark):
    found = spark.createDataFrame([("a", 0.4, [0.0, 0.0, 1.0, 1.0]), ("a", 0.9, [5.0, 5.0, 6.0, 6.0]), ("a", 0.9, [1.0, 5.0, 6.0, 6.0])], "id string, score double, box array<double>")
    images = spark.createDataFrame([("a", 90.0, 30.0), ("b", 90.0, 30.0)], "id string, w double, h double")
    got = {r["id"]: r["box"] for r in raster.best_box(found, "id", images, "w", "h").collect()}
    assert got == {"a": [1.0, 5.0, 6.0, 6.0], "b": [30.0, 10.0, 60.0, 20.0]}
    heights = spark.createDataFrame([(2.0,), (1.5,), (None,)], "h double")
    assert [r[0] for r in heights.select(boxes.zone_by_height(F.col("h"))).collect()] == ["Zone_0", "Zone_1", "Zone_1"]
    assert one(spark, boxes.feet_to_pixels(5.0, F.lit(0.0))) == 0 and one(spark, boxes.feet_to_pixels(5.0, F.lit(10.0))) == 15


def test_tile_stats(spark):
    df = spark.createDataFrame([("t", 0.0), ("t", 4.0), ("t", None), ("t", 9e38), ("t", float("nan"))], "t string, v double")
    r = raster.tile_stats(df, ["t"], "v", nodata=3.4e38).first()
    assert (r["n"], r["n_valid"], r["mean"], r["greatest"], r["zero_share"], r["missing_share"]) == (5, 2, 2.0, 4.0, 0.2, pytest.approx(0.6))
    assert raster.not_blank(raster.tile_stats(df, ["t"], "v", nodata=3.4e38), missing_limit=0.5).count() == 0
    assert raster.tile_stats(df.limit(0), ["t"], "v").count() == 0

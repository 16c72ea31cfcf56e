from __future__ import annotations

import json

from pyspark.sql import functions as F

from emberline.sources import readers, writers
from emberline.streaming import rollup

GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="node_type" attr.type="string"/>
<key id="d1" for="edge" attr.name="rel" attr.type="string"/>
<graph edgedefault="directed"><node id="a"><data key="d0">object</data></node><node id="b"/>
<edge source="a" target="b"><data key="d1">governed_by</data></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: r["attributes"] for r in nodes.collect()} == {"a": {"node_type": "object"}, "b": {}}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", {"rel": "governed_by"})]
    rows = spark.createDataFrame([("a", True, ["x", "y"], 'say "<&>"'), ("b", None, None, None)], "id string, aerial boolean, aliases array<string>, notes string")
    writers.graphml(rows, edges.select("src", "dst", F.lit("governed_by").alias("rel")), str(tmp_path / "out"))
    nodes, edges = readers.graphml(spark, str(tmp_path / "out"))
    assert {r["id"]: r["attributes"] for r in nodes.collect()} == {"a": {"aerial": "true", "aliases": '["x","y"]', "notes": 'say "<&>"'}, "b": {}}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", {"rel": "governed_by"})]


def test_graphml_of_many_attribute_names(spark, tmp_path):
    """More keys than any list of them would be cut to."""
    names = [f"n{i}" for i in range(1200)]
    keys = "".join(f'<key id="d{i}" for="node" attr.name="{n}" attr.type="string"/>\n' for i, n in enumerate(names))
    (tmp_path / "g.graphml").write_text(f'<graphml>{keys}<graph><node id="a">' + "".join(f'<data key="d{i}">{i}</data>' for i in range(1200)) + "</node></graph></graphml>")
    nodes, _ = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert nodes.first()["attributes"] == {n: str(i) for i, n in enumerate(names)}


def test_coco_pages(spark):
    """A parcel of more images than a page holds becomes several, with every image and box once."""
    images = spark.createDataFrame([("d", i) for i in range(23)] + [("e", 1)], "doc string, id int")
    boxes = spark.createDataFrame([("d", i % 23, i) for i in range(60)], "doc string, image_id int, category_id int")
    out = writers.coco(images, boxes, spark.createDataFrame([(1, "car")], "id int, name string"), "id", "image_id", page=10).collect()
    assert sorted((r["doc"], r["page_no"], len(r["images"])) for r in out) == [("d", 0, 10), ("d", 1, 10), ("d", 2, 3), ("e", 0, 1)]
    assert sum(len(r["annotations"] or []) for r in out) == 60
    assert all({a["image_id"] for a in r["annotations"] or []} <= {i["id"] for i in r["images"]} for r in out)


def test_tile_files_skip_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "p_r0_c1.json").write_text(json.dumps({"parcel_id": "p", "detections": [{"object_class": "car"}]}))
    (tmp_path / "p_r0_c2.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps({"parcel_id": "q"}))
    rows = readers.tile_files(spark, str(tmp_path)).select("parcel_id", "file_name").collect()
    assert [tuple(r) for r in rows] == [("p", "p_r0_c1.json")]


def test_csv_manifest(spark, tmp_path):
    df = spark.createDataFrame([("t1", "p", "x", 1)], "tile_path string, parcel_id string, extra string, row int")
    writers.csv(df, str(tmp_path / "m"), ["tile_path", "parcel_id", "site", "row"])
    got = readers.manifest(spark, str(tmp_path / "m"), "tile_path string, parcel_id string, site string, row int").first()
    assert tuple(got) == ("t1", "p", None, 1)


def test_texts_listing_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("x" * 300)
    got = {r["text"][:8] for r in readers.whole_texts(spark, str(tmp_path), "fallback text").collect()}
    assert got == {"fallback", "xxxxxxxx"}
    assert readers.listing(spark, str(tmp_path), "*.txt").count() == 2
    assert readers.images_base64(spark, str(tmp_path), "a.*").first()["payload"] == "c2hvcnQ="
    done = spark.createDataFrame([("p1",), ("p2",)], "parcel_id string")
    for _ in range(2):
        writers.append_done(done, str(tmp_path / "log"), "parcel_id")
    assert sorted(r[0] for r in readers.done_keys(spark, str(tmp_path / "log")).collect()) == ["p1", "p2"]


def test_json_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("p", 1), ("q", 2)], "parcel_id string, n int")
    writers.json_lines(df, str(tmp_path / "j"), by="parcel_id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    writers.lines(lines, str(tmp_path / "r"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["a", "b"]
    writers.sheets({"one": df, "two": df}, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book/two")).count() == 2
    (tmp_path / "tax.json").write_text(json.dumps([{"object_class": "a", "aliases": ["b"]}, {"object_class": "c"}]))
    assert readers.json_array(spark, str(tmp_path / "tax.json"), readers.TAXONOMY).count() == 2


def test_catalog_search(spark):
    items = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 2020), (5.0, 5.0, 6.0, 6.0, 2022)], "x0 double, y0 double, x1 double, y1 double, year int")
    assert [r["year"] for r in readers.catalog_search(items, 1, 1, 3, 3, 2022, 2020).collect()] == [2020]
    assert [r["year"] for r in readers.catalog_search(items, 5, 5, 7, 7, 2022, 2020).collect()] == [2022]
    assert readers.catalog_search(items, 50, 50, 70, 70, 2022, 2020).count() == 0


def test_coco(spark):
    images = spark.createDataFrame([("d", 1), ("e", 2)], "doc string, id int")
    boxes = spark.createDataFrame([("d", 1, 7)], "doc string, image_id int, category_id int")
    out = {r["doc"]: r for r in writers.coco(images, boxes, spark.createDataFrame([(1, "car")], "id int, name string"), "id", "image_id").collect()}
    assert len(out["d"]["annotations"]) == 1 and out["e"]["annotations"] is None and out["d"]["categories"][0]["name"] == "car"
    numbered = spark.range(1, 1002).select(F.col("id").alias("n"))
    assert sorted(r[0] for r in writers.label_tasks(numbered, "n").groupBy("batch_no").count().select("count").collect()) == [1, 500, 500]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id long, parcel string, at timestamp, bad boolean"
    rows = lambda day, ids: spark.createDataFrame([(i, "p", f"2025-01-{day:02d} 10:00:00", i % 2 == 0) for i in ids], "id long, parcel string, at string, bad boolean").withColumn("at", F.col("at").cast("timestamp"))
    rows(1, [1, 2, 2]).write.parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def go():
        stream = rollup.parcel_windows(rollup.tiles(spark, str(tmp_path / "in"), schema), "at", "parcel", "bad", late="1 day", key="id")
        rollup.run_once(stream, out, mark).awaitTermination(120)

    go()
    rows(20, [3]).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    rows(28, [4]).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = sorted((str(r["start"])[:10], r["n"], r["flagged"]) for r in spark.read.parquet(out).collect())
    assert got[0] == ("2025-01-01", 2, 1)

"""Queries that do the whole job where their SQL cuts it: against that SQL without its cut, and on small cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import graph, vote
from emberline.plans import detections, graphs
from tests.helpers import same_rows


def test_vote_counts_absent_answers(spark):
    """Answers 0 and 1 have the class, the other 9,998 lack it and outvote them."""
    row = "t string, n long, resp long, det int, object_class string, compliance_status string, severity string, confidence string"
    data = [("t", 10_000, i, 0, "x", "VIOLATION", "HIGH", "HIGH") for i in (0, 1)] + [("t", 10_000, i, 0, "y", "COMPLIANT", "LOW", "HIGH") for i in range(10_000)]
    out = {r["object_class"]: r for r in vote.vote(spark.createDataFrame(data, row), "t", "n").collect()}
    assert (out["x"]["compliance_status"], out["x"]["severity"], out["x"]["confidence"], out["x"]["first_resp"]) == ("UNCERTAIN", "NONE", "LOW", 0)
    assert (out["y"]["compliance_status"], out["y"]["confidence"], out["y"]["flagged"]) == ("COMPLIANT", "HIGH", False)


def test_vote_tie_with_absent_answers(spark):
    """Two have the class, two lack it: the kind that comes first wins."""
    row = "t string, n long, resp long, det int, object_class string, compliance_status string, severity string, confidence string"
    seen = lambda at: spark.createDataFrame([("t", 4, i, 0, "x", "VIOLATION", "HIGH", "HIGH") for i in at], row)
    got = [vote.vote(seen(at), "t", "n").first()["compliance_status"] for at in ((0, 2), (0, 1), (1, 2), (2, 3))]
    assert got == ["VIOLATION", "VIOLATION", "UNCERTAIN", "UNCERTAIN"]


def test_vote_tiles_uses_every_tile(spark, sf):
    """The answers of a parcel are as many as its tiles."""
    tiles = detections.tiles(spark, sf, ("parcel_id",)).filter("parcel_id is not null").count()
    seen = []
    plain = vote.vote

    def spy(answers, tile, responses):
        seen.append(answers.select(tile, responses).distinct().agg(F.sum(responses)).first()[0])
        return plain(answers, tile, responses)

    vote.vote = spy
    try:
        detections.vote_tiles(spark, sf).count()
    finally:
        vote.vote = plain
    with_detections = detections.detections(spark, sf, "object_class").select("parcel_id").filter("parcel_id is not null").distinct()
    missing = detections.tiles(spark, sf, ("parcel_id",)).join(with_detections, "parcel_id", "left_anti").filter("parcel_id is not null").count()
    assert seen[0] == tiles - missing


def test_iou_pairs_beyond_neighbours(spark, sf):
    assert detections.iou_pairs(spark, sf).filter("other_no > det_no + 1").count() > 0


STATUTE = """4291. (a) A person who owns a building shall do all of this:
(1) Maintain defensible space of 100 feet
from each side.
 (1)(A) Keep the first five feet free of all fuel. (2)(B) Thin the shrubs beyond that distance.
(2) short
(b) Remove dead and dying wood from the roof.
(3) Space out the crowns of all trees.
(a) A second section of the same letter that leaves."""


def test_marked_sections(spark):
    """Against the patterns of the survey, run by Python."""
    passes = [
        (r"\(([a-z])\)\s+(.*?)(?=\n\([a-z]\)|\Z)", 1), (r"\((\d)\)\s+(.*?)(?=\n\s*\(\d\)|\n\([a-z]\)|\Z)", 1),
        (r"\((\d)\)\(([A-Z])\)\s+(.*?)(?=\(\d\)\([A-Z]\)|\n\s*\(\d\)|\Z)", 2),
    ]
    want = {}
    for pattern, ids in passes:
        for m in re.finditer(pattern, STATUTE, re.DOTALL):
            body = re.sub(r"\s+", " ", m.group(ids + 1).strip())
            if len(body) > 15:
                want.setdefault("P_" + "".join(m.groups()[:ids]).upper(), body)
    df = spark.createDataFrame([(STATUTE,), ("no marker",), (None,)], "t string")
    got = [r[0] for r in df.select(text.marked_sections(F.col("t"), "P_")).collect()]
    assert [tuple(x) for x in got[0]] == list(want.items()) and set(want) == {"P_A", "P_B", "P_1", "P_3", "P_1A", "P_2B"}
    assert got[1] == [] and got[2] is None


def test_bullet_chunks(spark):
    page = "HEADING ABOVE THAT ENDS\nthe same line goes on and on here\n • Clear the gutters of leaves and needles\n\nUse metal mesh on all of the vents, always\no Move firewood thirty feet away from walls\nShort one\n"
    want = [re.sub(r"\s+", " ", c.strip()) for c in re.split(r"\n(?=\s*[•●o]\s|\s{0,2}[A-Z][a-z])", page) if len(c.strip()) >= 30]
    got = spark.createDataFrame([(page,)], "t string").select(text.bullet_chunks(F.col("t"))).first()[0]
    assert [x["text"] for x in got] == want and len(want) == 4


def test_graph_upsert_writes_over_rows_that_are_there(spark, sf, duck, monkeypatch):
    met = []
    plain = graph.upsert

    def spy(base, changes, keys, order):
        met.append(base.join(changes, keys, "left_semi").count())
        return plain(base, changes, keys, order)

    monkeypatch.setattr(graph, "upsert", spy)
    same_rows(graphs.graph_upsert(spark, sf), duck, graphs.SQL["graph_upsert"])
    assert met[0] > 0

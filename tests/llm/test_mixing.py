from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberline.llm import mixing

WORDS = {"notes": "inspector fence deck note tile", "letters": "dear neighbour thank please regards", "statutes": "pursuant section authority whereas hereby"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        s = rng.choice(["notes"] * 7 + ["letters"] * 2 + ["statutes"])
        text = " ".join(rng.choice(WORDS[s].split() + ["the", "of"]) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, None if i % 25 == 0 else s))
    rows += [(9001, None, "notes"), (9002, "", None)]
    return spark.createDataFrame(rows, "doc_id int, text string, source string")


TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_reaches_feasible_targets_and_reports_short_ones(spark, docs):
    targets = spark.createDataFrame(
        [("even", "notes", 0.5, 2), ("even", "letters", 0.3, 4), ("even", "statutes", 0.2, 9), ("tight", "statutes", 0.9, 2), ("tight", "notes", 0.1, 1), ("gone", "absent", 1.0, 5)], TARGETS
    )
    used, report, model = mixing.mix(docs, targets, "doc_id", "text", "source")
    assert model.held_out > 0.9
    got = {(r["mix_name"], r["source"]): r for r in report.collect()}
    for s, share in (("notes", 0.5), ("letters", 0.3), ("statutes", 0.2)):
        assert abs(got["even", s]["reached_share"] - share) < 0.03 and not got["even", s]["short"]
    assert got["tight", "statutes"]["short"] and got["gone", "absent"]["short"] and got["gone", "absent"]["source_tokens"] == 0
    limit = {("even", "notes"): 2, ("even", "letters"): 4, ("even", "statutes"): 9, ("tight", "statutes"): 2, ("tight", "notes"): 1}
    for r in used.collect():
        if r["source"]:
            assert r["copies"] <= limit[r["mix_name"], r["source"]]
    assert got["tight", "statutes"]["reached_tokens"] == got["tight", "statutes"]["capacity"]


def test_empty_and_single_source(spark, docs):
    targets = spark.createDataFrame([("m", "notes", 1.0, 1)], TARGETS)
    used, report, _ = mixing.mix(docs.limit(0), targets, "doc_id", "text", "source")
    assert used.count() == 0 and report.first()["reached_share"] == 0
    only = docs.filter("source = 'notes'")
    _, report, _ = mixing.mix(only, targets, "doc_id", "text", "source")
    assert report.first()["reached_share"] == 1.0
    assert mixing.mix(docs, targets.limit(0), "doc_id", "text", "source")[0].count() == 0


def test_rates_stay_within_limits():
    import numpy as np

    plan = mixing.Plan(("a", "b"), ("m",), np.array([[2.0, 0.0]]), np.array([[5.0, 5.0]]), labelled=(np.array([[-9.0, 3.0]]),))
    r = plan.rates(np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), 0, True)
    assert (r >= 0).all() and r.tolist() == [2.0, 1.0, 0.0]


def test_soft_membership_settles_and_documents_without_source_fill_up(spark, docs):
    targets = spark.createDataFrame([("even", "notes", 0.5, 2), ("even", "letters", 0.3, 4), ("even", "statutes", 0.2, 9), ("tight", "statutes", 0.5, 2), ("tight", "notes", 0.5, 2)], TARGETS)
    _, soft, _ = mixing.mix(docs, targets, "doc_id", "text", "source", 0.7)
    got = {(r["mix_name"], r["source"]): r for r in soft.collect()}
    assert all(r["settled"] for r in got.values())
    assert all(got["even", s]["residual"] < 0.02 for s in ("notes", "letters", "statutes"))
    used, hard, _ = mixing.mix(docs, targets, "doc_id", "text", "source")
    tight = {r["source"]: r for r in hard.filter("mix_name = 'tight'").collect()}
    assert tight["statutes"]["short"] and tight["statutes"]["used_up"] and tight["statutes"]["residual"] > 0.1
    # those without a source come only where one is missing
    filled = {r["mix_name"]: r["n"] for r in used.filter("source is null").groupBy("mix_name").agg(F.sum("n_tokens").alias("n")).collect()}
    assert filled.get("tight", 0) > 0 and "even" not in filled


def test_targets_beyond_the_bound_are_an_error(spark, docs, monkeypatch):
    targets = spark.createDataFrame([("m", f"s{i}", 0.1, 1) for i in range(9)], TARGETS)
    monkeypatch.setattr(mixing, "MAX_TARGETS", 8)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets, "doc_id", "text", "source")

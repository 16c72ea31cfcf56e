from __future__ import annotations

import random

import pytest

from emberline.llm import consensus

SKILL = {"good1": 0.95, "good2": 0.9, "good3": 0.9, "fair": 0.75, "random": 0.25, "liar": 0.03}


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(2)
    truth, rows = {}, []
    for i in range(400):
        truth[f"p{i}"] = t = rng.choice(consensus.LEVELS)
        for who in rng.sample(sorted(SKILL), 5):
            label = t if rng.random() < SKILL[who] else rng.choice([x for x in consensus.LEVELS if x != t])
            rows.append((f"p{i}", who, label))
    labels = spark.createDataFrame(rows, "item string, annotator string, label string")
    items, annotators = consensus.fit(labels)
    return truth, rows, labels, {r["item"]: r for r in items.collect()}, {r["annotator"]: r["skill"] for r in annotators.collect()}


def test_recovers_truth_and_skill(fitted):
    truth, rows, _, items, skill = fitted
    right = sum(items[k]["label"] == t for k, t in truth.items())
    votes = {}
    for item, _, label in rows:
        votes.setdefault(item, []).append(label)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[k] for k, v in votes.items())
    assert right >= majority and right >= 0.93 * len(truth)
    assert skill["liar"] < skill["random"] < skill["fair"] < min(skill["good1"], skill["good2"], skill["good3"])


def test_fewer_and_empty(spark):
    ddl = "item string, annotator string, label string"
    items, annotators = consensus.fit(spark.createDataFrame([("a", "x", "HIGH")], ddl), rounds=2)
    assert items.first()["label"] == "HIGH" and annotators.count() == 1
    items, annotators = consensus.fit(spark.createDataFrame([], ddl), rounds=1)
    assert items.count() == 0 and annotators.count() == 0


def test_tie_goes_to_the_first_level(spark):
    rows = [("a", "x", "HIGH"), ("a", "y", "LOW"), ("b", "x", "LOW"), ("b", "y", "HIGH")]
    items, _ = consensus.fit(spark.createDataFrame(rows, "item string, annotator string, label string"), rounds=3)
    assert {r["label"] for r in items.collect()} == {"LOW"}


def test_labels(spark):
    raw = ["High", " HIGH RISK", "Med", "crit.", "?", "", None, "UNKNOWN", "Low risk"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(consensus.usable_label(__import__("pyspark").sql.functions.col("r"))).collect()]
    assert got == ["HIGH", "HIGH", "MEDIUM", "CRITICAL", None, None, None, None, "LOW"]
    ddl = "sid int, p string, a string, l string, at timestamp, f array<string>"
    import datetime as d

    t = d.datetime
    data = [(1, "p", "a", "low", t(2025, 1, 1), ["x"]), (2, "p", "a", "high", t(2025, 1, 2), None), (3, "p", "a", "?", t(2025, 1, 3), None), (2, "p", "a", "high", t(2025, 1, 2), None),
            (4, "p", "b", "med", None, None), (5, "p", "b", "low", None, None), (6, None, "b", "low", None, None), (7, "q", None, "low", None, None)]
    got = consensus.latest_labels(spark.createDataFrame(data, ddl), "p", "a", "l", "at", "sid", ["f"]).collect()
    assert sorted((r["item"], r["annotator"], r["label"]) for r in got) == [("p", "a", "HIGH"), ("p", "b", "LOW")]


def test_agreement(fitted, spark):
    _, rows, labels, _, _ = fitted
    units = {}
    for item, _, label in rows:
        units.setdefault(item, []).append(label)
    n = sum(map(len, units.values()))
    off = sum(sum(a != b for a in u for b in u) / (len(u) - 1) for u in units.values())
    totals = [sum(u.count(x) for u in units.values()) for x in consensus.LEVELS]
    expected = sum(x * (n - x) for x in totals) / (n - 1)
    assert consensus.overall_agreement(labels).first()["alpha"] == pytest.approx(1 - off / expected)
    one = spark.createDataFrame([("a", "x", "LOW"), ("a", "y", "LOW"), ("b", "x", "LOW")], "item string, annotator string, label string")
    got = {r["item"]: r["agreement"] for r in consensus.label_agreement(one).collect()}
    assert got == {"a": 1.0, "b": None}


def test_findings(spark):
    data = [("p", "a", ["x", "y", None]), ("p", "b", ["x", "x"]), ("p", "c", None), ("q", "a", ["x"]), ("r", "a", None), ("r", "b", [])]
    got = {r["item"]: r["finding_agreement"] for r in consensus.finding_agreement(spark.createDataFrame(data, "item string, annotator string, findings array<string>")).collect()}
    assert got == {"p": pytest.approx(2 / (3 * 2)), "q": None, "r": None}


def test_many_rounds_and_a_join_for_the_skills(fitted, spark):
    """Skills settle before the rounds end, and joined skills give what broadcast ones do."""
    _, _, labels, items, skill = fitted
    _, annotators = consensus.fit(labels)
    assert all(r["residual"] <= 1e-3 and r["rounds"] < 100 for r in annotators.collect())
    few = labels.filter("item < 'p2'")
    a, b = consensus.fit(few, rounds=4), consensus.fit(few, rounds=4, shared=0)
    assert {r["item"]: (r["label"], round(r["posterior"], 9)) for r in a[0].collect()} == {r["item"]: (r["label"], round(r["posterior"], 9)) for r in b[0].collect()}
    assert {r["annotator"]: round(r["skill"], 9) for r in a[1].collect()} == {r["annotator"]: round(r["skill"], 9) for r in b[1].collect()}

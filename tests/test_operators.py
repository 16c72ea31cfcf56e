"""Operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import graph, joins, model, sample, suppress, vote
from emberline.operators.scan import running_total


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_total(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), i, rng.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(data, "s string, i int, n int")
    got = {r["i"]: r["before"] for r in running_total(df, ["s", "i"], "n").collect()}
    seen = 0
    for _, i, n in sorted(data):
        assert got[i] == seen
        seen += n or 0
    assert running_total(df.limit(0), ["s", "i"], "n").count() == 0


def test_surrogate_ids(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(200)], "k string, new_id int")
    got = {r["k"]: r["new_id"] for r in joins.surrogate_ids(df, ["k"]).collect()}
    assert [got[f"k{i:03d}"] for i in range(200)] == list(range(1, 201))


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0


def greedy(items, threshold):
    out = []
    for r in sorted(items, key=lambda x: x[3:]):
        b = r[2]
        if b is None or len(b) < 4 or all(q[2] is None or len(q[2]) < 4 or iou(q[2], b) <= threshold for q in out):
            out.append(r)
    return out


@pytest.mark.parametrize("most", [5000, 3])
def test_suppress_is_greedy(spark, most):
    """Both ways, vectorised and in rounds, give the greedy result; one group holds most rows."""
    rng = random.Random(most)
    data = []
    for i in range(400):
        x, y = rng.randint(0, 200), rng.randint(0, 200)
        box = [float(x), float(y), float(x + rng.randint(10, 60)), float(y + rng.randint(10, 60))]
        data.append((rng.choice([None, "a", "b", "a", "a"]), rng.choice(["l", "m"]), rng.choice([box] * 9 + [[], None]), rng.randint(0, 3), i))
    df = spark.createDataFrame(data, "g string, l string, box array<double>, r int, i int")
    got = {r["i"] for r in suppress.suppress(df, ["g", "l"], "box", ["r", "i"], 0.3, most=most).collect()}
    want = {r[4] for g in (None, "a", "b") for l in "lm" for r in greedy([d for d in data if d[0] == g and d[1] == l], 0.3)}
    assert got == want


def test_suppress_fixture(spark):
    data = [("p", [0.0, 0.0, 10.0, 10.0], -0.9), ("p", [1.0, 1.0, 10.0, 10.0], -0.8), ("p", [20.0, 20.0, 30.0, 30.0], -0.7)]
    df = spark.createDataFrame(data, "g string, box array<double>, r double")
    assert sorted(r["r"] for r in suppress.suppress(df, ["g"], "box", ["r"]).collect()) == [-0.9, -0.7]
    assert suppress.suppress(df.limit(0), ["g"], "box", ["r"]).count() == 0


ANSWERS = "tile string, n int, resp int, det int, object_class string, compliance_status string, severity string, confidence string"


def voted(spark, data):
    return {r["object_class"]: r for r in vote.vote(spark.createDataFrame(data, ANSWERS), "tile", "n").collect()}


def test_vote(spark):
    out = voted(spark, [("t", 3, 0, 0, "x", "VIOLATION", "HIGH", "HIGH"), ("t", 3, 1, 0, "x", "COMPLIANT", "NONE", "MEDIUM")])["x"]
    assert (out["compliance_status"], out["confidence"], out["flagged"], out["all_agree"]) == ("UNCERTAIN", "LOW", True, False)
    out = voted(spark, [("t", 2, i, 0, "x", "VIOLATION", "HIGH", "HIGH") for i in range(2)])["x"]
    assert (out["compliance_status"], out["confidence"], out["all_agree"]) == ("VIOLATION", "HIGH", True)
    tie = ["COMPLIANT", "VIOLATION", "VIOLATION", "COMPLIANT"]
    out = voted(spark, [("t", 4, i, 0, "x", s, "LOW", "HIGH") for i, s in enumerate(tie)])["x"]
    assert (out["compliance_status"], out["flagged"], out["all_agree"]) == ("COMPLIANT", False, True)
    out = voted(spark, [("t", 2, 0, 0, "x", "VIOLATION", "HIGH", "HIGH"), ("t", 2, 1, 0, "x", "COMPLIANT", "LOW", "HIGH")])["x"]
    assert (out["compliance_status"], out["flagged"]) == ("UNCERTAIN", True)
    out = voted(spark, [("t", 1, 0, 1, "x", "COMPLIANT", "LOW", "HIGH"), ("t", 1, 0, 0, "x", "VIOLATION", None, None), ("t", 1, 0, 2, None, "x", "x", "x")])
    assert set(out) == {"x"} and (out["x"]["compliance_status"], out["x"]["flagged"], out["x"]["severity"]) == ("VIOLATION", False, "NONE")
    assert voted(spark, []) == {}


def test_vote_ignores_partitioning(spark):
    rng = random.Random(3)
    data = [(f"t{rng.randint(0, 5)}", 3, r, d, rng.choice("xyz"), rng.choice(["VIOLATION", "COMPLIANT"]), "LOW", "HIGH") for r in range(3) for d in range(20)]
    df = spark.createDataFrame(data, ANSWERS)
    assert rows_of(vote.vote(df, "tile", "n")) == rows_of(vote.vote(df.repartition(7, "det"), "tile", "n"))


def test_first_success(spark):
    df = spark.createDataFrame([("a", 0, False, "x"), ("a", 1, True, "y"), ("a", 2, True, "z"), ("b", 0, False, "p"), ("b", 1, None, "q")], "k string, attempt int, ok boolean, v string")
    assert {r["k"]: r["v"] for r in vote.first_success(df, "k", "attempt", "ok").collect()} == {"a": "y", "b": "q"}


def test_band_pairs_and_components(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0), (3, 80.0, 0.0), (4, 200.0, 0.0), (5, None, 0.0)], "id int, x double, y double")
    pairs = joins.band_pairs(df, "id", "x", "y", 50.0)
    assert rows_of(pairs) == [(1, 2), (2, 3)]
    found = graph.components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")), df)
    assert rows_of(found) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    with pytest.raises(ValueError):
        joins.band_pairs(df, "id", "x", "y", 0)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 360)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "src int, dst int")
    want = {x: root(x) for x in [*parent, 7]}
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_covering(spark):
    rng = random.Random(9)
    box = lambda i: (i, x := float(rng.randint(-50, 300)), y := float(rng.randint(-50, 300)), x + rng.randint(0, 90), y + rng.randint(0, 90))  # noqa: E731, F841
    a, b = [box(i) for i in range(60)], [box(i) for i in range(40)]
    ddl = "id int, x0 double, y0 double, x1 double, y1 double"
    want = sorted(
        (p[0], q[0]) for p in a for q in b
        if p[3] > p[1] and p[4] > p[2] and q[3] > q[1] and q[4] > q[2] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
    )
    assert rows_of(joins.covering(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), 64.0)) == want


def test_small_joins(spark):
    left = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("a", "v3"), ("b", "v1")], "k string, v string")
    right = spark.createDataFrame([("a", "z1"), ("c", "z9")], "k string, z string")
    assert rows_of(joins.capped_cross(left, right, "k", "v", "z", 2)) == [("a", "v1", "z1"), ("a", "v2", "z1"), ("b", "v1", "—"), ("c", "—", "z9")]
    assert rows_of(joins.pending(left, right, ["k"])) == [("b", "v1")]
    assert rows_of(joins.with_default(left.select("k").distinct(), right, ["k"], {"z": "-"})) == [("a", "z1"), ("b", "-")]
    points = spark.createDataFrame([(1.0, 0.5), (5.0, 5.0), (None, 0.0)], "x double, y double")
    assert joins.snapped_cells(points, "x", "y", 1.0, 2, 1).count() == 2


def test_graph_writes(spark):
    base = spark.createDataFrame([("a", "b", 1, 0)], "src string, dst string, w int, seq int")
    more = spark.createDataFrame([("a", "b", 2, 5), ("a", "b", 3, 9), ("c", "d", 4, 1)], base.schema)
    assert {(r["src"], r["w"]) for r in graph.upsert(base, more, ["src", "dst"], "seq").collect()} == {("a", 3), ("c", 4)}
    assert {(r["src"], r["w"]) for r in graph.insert_absent(base, more, ["src", "dst"]).collect()} == {("a", 1), ("c", 4)}
    assert graph.upsert(base.limit(0), more.limit(0), ["src", "dst"], "seq").count() == 0
    assert rows_of(graph.degree(spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string"))) == [("a", 3), ("b", 1)]
    scoped = graph.expand_scope(spark.createDataFrame([(1, "ALL"), (2, "Zone_1"), (3, None)], "i int, z string"), "z")
    assert scoped.count() == 7


def test_scored_edges_keep_all_at_the_floor(spark):
    objects = spark.createDataFrame([("propane_tank", ["lpg"]), ("car", None)], "object_class string, aliases array<string>")
    rules = spark.createDataFrame([("r1", "keep lpg away"), ("r2", None)], "rule_id string, text string")
    got = {(r["src"], r["dst"]): r["confidence"] for r in graph.scored_edges(objects, rules, "governed_by", ("fuel",)).collect()}
    assert got == {("propane_tank", "r1"): 0.8, ("car", "r1"): 0.4, ("propane_tank", "r2"): 0.4, ("car", "r2"): 0.4}
    assert graph.scored_edges(objects, rules, "g", ("fuel",), least=0.5).count() == 1
    assert graph.scored_edges(objects.limit(0), rules, "g", ("fuel",)).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None) for i in range(100)], "id int, s int")
    assert sample.k_per_stratum(df, ["s"], "id", 2).count() == 7  # three strata and NULL, which has one row
    assert sample.padded_sample(df, ["s"], "id", 2, 30).count() == 30
    assert sample.exact_fraction(df, "id", 0.3).count() == 30
    assert sample.exact_fraction(df.limit(1), "id", 0.3).count() == 1
    assert sample.exact_fraction(df.limit(0), "id", 0.3).count() == 0
    assert rows_of(sample.exact_fraction(df, "id", 0.3)) == rows_of(sample.exact_fraction(df.repartition(9), "id", 0.3))


def test_model_hook(spark):
    df = spark.range(20).withColumn("answer", F.lit("old"))
    out = model.run_model(df, model.stub(), "answer", width=3).collect()
    assert len(out) == 20 and all(r["error"] is None and "detections" in r["answer"] for r in out)

    def broken():
        def answer(items):
            if any(x["id"] == 7 for x in items):
                raise RuntimeError("no")
            return [{"ok": 1} for _ in items]

        return answer

    errors = [r for r in model.run_model(df, broken, "answer").collect() if r["error"]]
    assert [r["id"] for r in errors] == [7] and errors[0]["error"] == "RuntimeError: no"


def test_kept_mask():
    assert suppress.kept(np.zeros((0, 4)), 0.5).tolist() == []


def test_cut_keeps_the_size_estimate_of_the_rows(spark):
    """Twenty rounds of a join with itself: the estimate stays near the size of what was written."""
    from emberline.session import cut

    df = cut(spark.range(500).withColumn("a", F.col("id") % 7))
    for _ in range(20):
        df = cut(df.join(df.groupBy("a").agg(F.count("*").alias("n")), "a").select("id", "a"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert df.count() == 500 and size < 10 * 500 * 16


def test_components_of_paths_rings_and_hubs(spark):
    path = [(i, i + 1) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    hub = [(2500, 2000 + i) for i in range(400)]
    edges = spark.createDataFrame(path + ring + hub + [(5, 5), (None, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.components(edges, spark.createDataFrame([(9999,)], "id long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert {got[2000 + i] for i in range(400)} == {2000} == {got[2500]} and got[9999] == 9999


def test_release_removes_what_was_written(spark):
    import os

    from emberline.session import new_path, release, staged, written

    held = len(written(spark))
    path = new_path(spark, "x")
    staged(spark.range(3), "x", path)
    assert os.path.isdir(path)
    release(spark, held)
    assert not os.path.exists(path) and len(written(spark)) == held

"""Clusters of points by distance, against brute force and against the pairs that they don't form."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.operators import graph, joins
from emberline.plans import graphs
from emberline.session import release, written

DDL = "id long, x double, y double"


def brute(points, d):
    parent = {p[0]: p[0] for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def linked(p, q):
        if None in (*p, *q) or not all(map(math.isfinite, (*p[1:], *q[1:]))):
            return False
        dx, dy = p[1] - q[1], p[2] - q[2]
        return dx * dx + dy * dy <= d * d

    for i, p in enumerate(points):
        for q in points[:i]:
            a, b = root(p[0]), root(q[0])
            if a != b and linked(p, q):
                parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def found(spark, points, d):
    return {r["id"]: r["component"] for r in graph.clusters(spark.createDataFrame(points, DDL), "id", "x", "y", d).collect()}


@pytest.mark.parametrize("side", [20.0, 45.0, 120.0])
def test_clusters_against_brute_force(spark, side):
    rng = random.Random(int(side))
    ids = rng.sample(range(5000), 350)
    points = [(i, rng.uniform(-side, side), rng.uniform(-side, side)) for i in ids]
    want = brute(points, 5.0)
    assert found(spark, points, 5.0) == want
    assert len(set(want.values())) > (1 if side > 20 else 0)


def test_clusters_compare_every_point_where_no_link_is_sure(spark):
    # two heaps of many points: their points farthest towards each other are too far apart, two others are near enough (or a hair too far)
    rng = random.Random(3)
    heap = lambda first, x0, x1: [(first + i, rng.uniform(x0, x1), rng.uniform(0.1, 1.0)) for i in range(300)]
    base = [*heap(100, 0.0, 20.0), *heap(1000, 170.0, 189.0)]
    base += [(10, 21.0, 1.0), (20, 166.0, 69.0)]  # farthest to the right and to the left
    for shift, n in ((0.0, 1), (1e-9, 2)):
        points = [*base, (5, 20.5, 0.0), (6, 170.5 + shift, 0.0)]
        got = found(spark, points, 150.0)
        assert got == brute(points, 150.0)
    lone = [(1, 0.0, 0.0), (2, 150.0 + 1e-9, 0.0), (3, 0.0, -150.0), (4, 300.0, 0.0), (5, 390.0, 120.0)]
    assert found(spark, lone, 150.0) == {1: 1, 2: 2, 3: 1, 4: 2, 5: 2}


def test_clusters_of_odd_rows(spark):
    points = [
        (1, None, 0.0), (2, 0.0, None), (3, float("nan"), 0.0), (4, 0.0, float("nan")), (5, float("inf"), 0.0), (6, float("inf"), 0.0), (7, -0.0, 0.0),
        (8, 0.0, -0.0), (9, -3.0, -4.0), (12, 500.0, 0.0), (12, 520.0, 40.0), (12, 900.0, 0.0), (11, 904.0, 3.0), (13, 500.0, 5.0), (12, None, 1.0), (None, 0.0, 0.0),
    ]
    assert found(spark, points, 5.0) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 7, 12: 11, 11: 11, 13: 11}
    assert found(spark, [], 5.0) == {}
    with pytest.raises(ValueError):
        found(spark, [], 0.0)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, 1e30, 0.0)], 5.0)


def test_clusters_equal_components_of_pairs(spark):
    rng = random.Random(11)
    points = spark.createDataFrame([(i, rng.uniform(0, 300), rng.gauss(0, 40)) for i in range(3000)], DDL)
    pairs = joins.band_pairs(points, "id", "x", "y", 4.0).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    want = {r["id"]: r["component"] for r in graph.components(pairs, points).collect()}
    assert {r["id"]: r["component"] for r in graph.clusters(points, "id", "x", "y", 4.0).collect()} == want
    assert 1 < len(set(want.values())) < 1500


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_rounds_and_in_one_task(spark, kind):
    rng = random.Random(17)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 700)] + [(900, x) for x in range(801, 950)]
    df = spark.createDataFrame([*pairs, (None, 4)], "src long, dst long").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    ids = spark.createDataFrame([(5000,), (900,)], "id long").select(F.col("id").cast(kind).alias("id"))
    both = [sorted(tuple(r) for r in graph.components(df, ids, most=m).collect()) for m in (0, 300, 500_000)]
    assert both[0] == both[1] == both[2] and len({c for _, c in both[0]}) > 3


def dense(spark, tmp_path) -> tuple[str, int]:
    """A customer table of 3,000 points of which every two are within the distance, apart from one."""
    n = 3000
    rows = [(k * 9973, float(k % 97)) for k in range(n)] + [(1, 9000.0)]  # c_custkey * 7919 % 9973 is 0 for all but the last
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path), n


def rows_written(spark, since: int) -> int:
    return sum(spark.read.parquet(p).count() for p in written(spark)[since:] if any(Path(p).glob("*.parquet")))


def test_cluster_extent_forms_no_pairs(spark, tmp_path):
    folder, n = dense(spark, tmp_path)
    held = len(written(spark))
    got = sorted(tuple(r) for r in graphs.cluster_extent(spark, folder).collect())
    names = graphs.cluster_extent(spark, folder).columns
    want = {0: (0, n, -10.0, 106.0, 0.0, 10.0, 0.0), 1: (1, 1, 8990.0, 9010.0, 7909.0, 7929.0, 7919.0)}
    assert names == ["component", "n", "x0", "x1", "y0", "y1", "cy"] and got == [want[0], want[1]]
    assert rows_written(spark, held) < 100  # the pairs would be four million
    release(spark, held)


def test_components_query_forms_no_pairs(spark, tmp_path):
    folder, n = dense(spark, tmp_path)
    held = len(written(spark))
    got = {r["id"]: r["component"] for r in graphs.components(spark, folder).collect()}
    assert got == {k * 9973: 0 for k in range(n)} | {1: 1}
    assert rows_written(spark, held) < 100
    release(spark, held)

from __future__ import annotations

import random
from itertools import combinations

import pytest

from emberline.llm.cooccurrence import PairTable, signed_pairs

DDL = "chip long, objects array<string>"


def brute(baskets):
    single, pair = {}, {}
    for items in baskets.values():
        s = sorted({x.strip().lower() for x in items or [] if x is not None and x.strip()})
        for x in s:
            single[x] = single.get(x, 0) + 1
        for p in combinations(s, 2):
            pair[p] = pair.get(p, 0) + 1
    return single, pair


def check(table, baskets):
    single, pair = brute(baskets)
    assert {r["item"]: r["n"] for r in table.singles().collect()} == single
    assert {(r["item_a"], r["item_b"]): r["n"] for r in table.pairs().collect()} == pair
    assert table.total() == len(baskets)


def test_increments_equal_recounting(spark):
    rng = random.Random(6)
    make = lambda: rng.choice([None, [], [rng.choice(["a", " B", "c ", "D", "e", None, ""]) for _ in range(rng.randint(0, 6))]])
    state = {i: make() for i in range(60)}
    table = PairTable(spark, buckets=4)
    table.apply(spark.createDataFrame([*state.items(), (0, state[0])], DDL), "chip", "objects")
    check(table, state)
    change = {i: make() for i in range(40, 90)}
    table.apply(spark.createDataFrame([*change.items(), (None, ["a"])], DDL), "chip", "objects")
    state |= change
    check(table, state)
    table.apply(spark.createDataFrame([], DDL), "chip", "objects")
    check(table, state)
    assert table.version == 3
    assert PairTable(spark, table.path, buckets=4).version == 3


def test_scores_and_changes(spark):
    table = PairTable(spark, buckets=2)
    table.apply(spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["c", "d"])], DDL), "chip", "objects")
    s = {(r["item_a"], r["item_b"]): r for r in table.scores().collect()}
    assert s["a", "b"]["lift"] == pytest.approx(2 * 4 / 4) and s["a", "b"]["jaccard"] == 1.0 and s["c", "d"]["lift"] == pytest.approx(2.0)
    table.apply(spark.createDataFrame([(4, ["c"]), (3, ["c", "d"])], DDL), "chip", "objects")
    assert table.scores(since=1).count() == 0  # counts are the same again
    table.apply(spark.createDataFrame([(3, ["c"])], DDL), "chip", "objects")
    assert [(r["item_a"], r["item_b"]) for r in table.scores(since=2).collect()] == []
    table.apply(spark.createDataFrame([(9, ["z", "a"])], DDL), "chip", "objects")
    # n_a changed for a-b, a-z is new
    assert sorted((r["item_a"], r["item_b"]) for r in table.scores(since=3).collect()) == [("a", "b"), ("a", "z")]
    assert {(r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["n"]) for r in table.scores().collect()} == {("a", "b"): (3, 2, 5), ("a", "z"): (3, 1, 5)}


def test_a_small_batch_rewrites_only_its_buckets(spark):
    rng = random.Random(8)
    state = {i: [f"i{rng.randrange(400)}" for _ in range(4)] for i in range(500)}
    table = PairTable(spark, buckets=32)
    table.apply(spark.createDataFrame([*state.items()], DDL), "chip", "objects")
    table.apply(spark.createDataFrame([(7, ["i1", "i2", "i3"])], DDL), "chip", "objects")
    state[7] = ["i1", "i2", "i3"]
    check(table, state)
    held = table.listed(2)
    fresh = {t: sum(v == 2 for v in held[t].values()) for t in ("baskets", "singles", "pairs")}
    assert fresh["baskets"] == 1 and fresh["singles"] <= 7 and 0 < fresh["pairs"] < 32


def test_wide_baskets_in_blocks(spark):
    """A basket of several blocks gives every pair once, also when it changes."""
    rng = random.Random(9)
    names = [f"n{i:03d}" for i in range(70)]
    rows = [(rng.sample(names, rng.randint(0, 60)), rng.sample(names, rng.randint(0, 60))) for _ in range(12)]
    want = {}
    for was, now in rows:
        for side, other, d in ((now, was, 1), (was, now, -1)):
            for p in combinations(sorted(side), 2):
                if not set(p) <= set(other):
                    want[p] = want.get(p, 0) + d
    df = spark.createDataFrame([(sorted(a), sorted(b)) for a, b in rows], "was array<string>, now array<string>")
    for block in (7, 256):
        got = {}
        for r in signed_pairs(df, block).collect():
            got[r["item_a"], r["item_b"]] = got.get((r["item_a"], r["item_b"]), 0) + r["d"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_the_latest_of_a_batch_counts(spark):
    table = PairTable(spark, buckets=2)
    rows = [(1, ["a", "b"], 5), (1, ["c"], 9), (1, ["d", "e"], None), (2, ["x", "y"], None), (2, ["b", "a"], None)]
    table.apply(spark.createDataFrame(rows, DDL + ", at int"), "chip", "objects", "at")
    check(table, {1: ["c"], 2: ["a", "b"]})


def test_empty(spark):
    table = PairTable(spark)
    table.apply(spark.createDataFrame([], DDL), "chip", "objects")
    assert table.scores().count() == 0

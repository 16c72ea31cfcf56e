from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberline.llm import packing, tokens


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        source = rng.choice(["hot"] * 12 + ["a", "b", "c", None])
        data.append((i, source, rng.choice([0, None, rng.randint(1, 60), rng.randint(1, 60), rng.randint(50, 900)]), "x"))
    data.append((9000, "a", 5000, "x"))
    data.append((9001, "b", 2000, "x"))
    return data, spark.createDataFrame(data, "id int, source string, n int, window string")


def test_each_item_once_and_nothing_overflows(items):
    data, df = items
    out = packing.pack(df, "id", "source", "n", capacity=1000, containers_per_window=64).collect()
    held, tokens_of = {}, {}
    for r in out:
        held[r["window"], r["container"]] = held.get((r["window"], r["container"]), 0) + r["size"]
        tokens_of.setdefault(r["item"], []).append((r["piece_no"], r["token_from"], r["size"]))
    assert max(held.values()) <= 1000
    assert {k: sum(x[2] for x in v) for k, v in tokens_of.items()} == {i: n or 0 for i, _, n, _ in data}
    assert {k for k, v in tokens_of.items() if len(v) > 1} == {9000, 9001}
    assert [x[1] for x in sorted(tokens_of[9000])] == [0, 1000, 2000, 3000, 4000]
    assert 1 - sum(held.values()) / (1000 * len(held)) < 0.05


def test_windows_keep_proportions(items):
    data, df = items
    out = packing.window_report(packing.pack(df, "id", "source", "n", capacity=1000, containers_per_window=64)).collect()
    total = sum(n or 0 for _, _, n, _ in data)
    own = sum(n or 0 for _, s, n, _ in data if s == "hot") / total
    per_window = {}
    for r in out:
        per_window[r["window"]] = per_window.get(r["window"], 0) + r["tokens"]
    for r in out:
        if r["source"] == "hot" and per_window[r["window"]] > 32_000:
            assert abs(r["share"] - own) < 0.06
    assert all(v <= 66_000 for v in per_window.values())


def test_targets(items):
    _, df = items
    out = packing.pack(df, "id", "source", "n", capacity=1000, shares={"hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.06, None: 0.04}, containers_per_window=32)
    first = {r["source"]: r["share"] for r in packing.window_report(out).filter("window = 0").collect()}
    assert abs(first["hot"] - 0.4) < 0.08 and abs(first["a"] - 0.3) < 0.08


def test_empty_items_do_not_pile_up(spark):
    """Windows are of bounded rows also where nothing has a size."""
    df = spark.range(5000).select(F.col("id"), F.lit("s").alias("source"), F.lit(0).alias("n")).unionByName(spark.createDataFrame([(9000, "s", 2500)], "id long, source string, n int"))
    out = packing.pack(df, "id", "source", "n", capacity=1000, containers_per_window=4)
    rows = {r["window"]: r["n"] for r in out.groupBy("window").agg(F.count("*").alias("n")).collect()}
    assert sum(rows.values()) == 5003 and max(rows.values()) <= 4 * 1000 // 3 + 1
    assert [r["item"] for r in packing.divided(out).collect()] == [9000]


def test_best_fit():
    assert packing.best_fit([5, 5, 6, 4], 10) == [1, 1, 0, 0]
    assert packing.best_fit([], 10) == []


def test_empty(spark):
    df = spark.createDataFrame([], "id int, source string, n int")
    assert packing.pack(df, "id", "source", "n").count() == 0
    assert packing.fill_report(packing.pack(df, "id", "source", "n")).first()["containers"] == 0


def test_tokens(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "señor — ok\r\n", "word " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in tokens.with_tokens(df).collect()}
    assert (got[0], got[1], got[2]) == (2, 0, 0) and got[3] > 1 and got[5] >= 20_000
    enc = tokens.encoding(tokens.default_vocabulary())
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    assert df.select(tokens.token_count(F.col("text"))).count() == 6

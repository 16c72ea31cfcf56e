from __future__ import annotations

import random

from pyspark.sql import functions as F

from emberline.llm import truncation

PLACES = ["rear wall", "porch rail", "garage corner", "chimney side"]
ENDS = ["the strip below it is clear", "the spacing looks too tight", "the view is blocked by foliage"]


def make(rng):
    kind = rng.randrange(3)
    place, end, v = rng.choice(PLACES), rng.choice(ENDS), rng.choice(["VIOLATION", "COMPLIANT"])
    if kind == 0:
        return f"LOCATE: {rng.randint(1, 60)} ft from the {place}, Zone_{rng.randint(0, 2)}. ASSESS: {end}, so {v}."
    if kind == 1:
        return f"- where: {rng.randint(1, 60)} ft from the {place}\n- verdict: {v} / HIGH"
    return f"It sits {rng.randint(1, 60)} ft from the {place}; {end}. Action: {v}, HIGH"


def test_finds_cuts(spark):
    rng = random.Random(8)
    rows, cut = [], {}
    for i in range(3000):
        t = make(rng)
        cut[i] = i % 20 == 0
        if cut[i]:
            t = t[: rng.randint(15, len(t) - 2)] + rng.choice(["", "", "...", " [cut]", "\n"])
        elif i % 50 == 1:
            t += "\n"
        rows.append((i, "k", t))
    rows += [(5000, "k", None), (5001, "k", ""), (5002, "k", " \n "), (5003, "k", '{"a": [{"b": 1}'), (5004, "k", '```json\n{"a": 1}\n```'), (5005, "k", "unlike all others")]
    df = spark.createDataFrame(rows, "id int, kind string, text string").withColumn("is_cut", F.lit(True)).withColumn("extra", F.lit(1))
    got = {r["id"]: r["is_cut"] for r in truncation.find_cut(df).collect()}
    assert not any(got[i] for i in (5000, 5001, 5002, 5004, 5005)) and got[5003]
    hit = [i for i in cut if got[i]]
    right = sum(cut[i] for i in hit)
    assert right >= 0.98 * len(hit) and right >= 0.95 * sum(cut.values())
    assert len(got) == len(rows)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([], "id int, kind string, text string")
    assert truncation.find_cut(df).count() == 0
    same = spark.createDataFrame([(i, "k", "All is well here, so fine.") for i in range(50)], "id int, kind string, text string")
    assert truncation.find_cut(same).filter("is_cut").count() == 0


def test_evidence_is_a_prefix_join(spark):
    """ending and going against counting by hand."""
    texts = ["^a", "x, one two.", "x, one two.", "x, one", "x, one two. more", "y, one two"]
    df = spark.createDataFrame([("k", t) for t in texts], "kind string, text string").select("kind", truncation.clauses(F.col("text")).alias("c"))
    ends = df.select("kind", F.xxhash64(F.element_at("c", -2)).alias("before"), F.element_at("c", -1).alias("clause"))
    got = {(r["clause"], r["ending"], r["going"]) for r in truncation.ending_evidence(truncation.clause_counts(df), ends).collect()}
    assert ("one", 1, 3) in got and ("one two.", 2, 1) in got


def test_marks(spark):
    raw = ["a...", "a [cut]", "a<more>", "a�", "a (VIOLATION, HIGH)", "a.", "a… [cut]  ", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(truncation.unmarked(F.col("t"))).collect()]
    assert got == ["a", "a", "a", "a", "a (VIOLATION, HIGH)", "a.", "a", None]

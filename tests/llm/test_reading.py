from __future__ import annotations

import random

from pyspark.sql import functions as F

from emberline.llm import reading

EASY = ["The dog can run.", "We saw a red bin.", "Put the mat by the door.", "My cat is on the bed."]
MIDDLE = ["The inspector noted that the wooden fence close to the road could catch embers during the dry summer season.", "Several neighbours offered to share a trailer so that everyone can move the objects away before the end of June."]
HARD = ["Notwithstanding contradictory determinations previously communicated, interjurisdictional administrative authorization presupposes comprehensive evidentiary documentation of photogrammetric classification uncertainties throughout applicable residential jurisdictions.",
        "Considerable methodological heterogeneity complicates retrospective environmental characterization, particularly because atmospheric attenuation and geometric misregistration simultaneously influence underlying observations."]


def test_bands(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(6, 12)))) for i, pool in enumerate([EASY, MIDDLE, HARD] * 60)]
    broken = [(1000, "1) " + "\n- ".join(rng.choice(EASY).rstrip(".") for _ in range(10)))]  # no full stops: the formula sees one long sentence
    extra = [(2000, None), (2001, ""), (2002, "12 34 --"), (2003, "zzyzx")]
    df = spark.createDataFrame(rows + broken + extra, "doc_id int, text string").withColumn("words", F.lit("x"))
    got = {r["key"]: r for r in reading.reading_levels(df, "doc_id", "text").collect()}
    want = ["easy", "middle", "hard"]
    assert sum(got[i]["band"] == want[i % 3] for i in range(180)) >= 176
    assert got[1000]["band"] == "easy"
    assert not {2000, 2001, 2002} & set(got) and got[2003]["words"] == 1


def test_words_of_hard_texts_come_late(spark):
    rows = [(i, " ".join(pool)) for i, pool in enumerate([EASY, MIDDLE, HARD] * 20)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    grade = {r["word"]: r["grade"] for r in reading.acquisition_grades(reading.graded_documents(df, "doc_id", "text")).filter("fold = 0").collect()}
    assert grade["dog"] < grade["inspector"] < grade["interjurisdictional"]
    assert grade["the"] <= grade["inspector"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert reading.reading_levels(df, "doc_id", "text").count() == 0


def test_formula():
    read = lambda t: reading.read_document(t, reading.Syllables())
    assert read("The cat sat on the mat.")[2] < 1 and read("Go.")[1] == 1
    assert read("")[1:] == (0, None) and read(None)[1:] == (0, None) and read("12 — 34")[1:] == (0, None)
    assert read("Don't, don't l’été")[0] == {"don't": 2, "l’été": 1}
    assert read("a" * 200_000)[1] == 1 and read(("x" * 50_000 + "\n") * 4)[1] == 4
    # one sentence of five words; a heading of two words is none
    assert abs(read("Short head\n\nThe red fire engine came.")[2] - (0.39 * 7 + 11.8 * 8 / 7 - 15.59)) < 1e-9


def test_no_document_grades_its_own_words(spark):
    """A word that only one document has is unknown to it, and known to no other of its half."""
    rows = [(i, "the red dog ran to the old barn. " * 3 + ("zebra" if i == 0 else "")) for i in range(40)]
    graded = reading.graded_documents(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text")
    own = graded.filter("key = 0").first()["fold"]
    assert [r["fold"] for r in reading.acquisition_grades(graded).filter("word = 'zebra'").collect()] == [1 - own]
    known = {r["key"]: r["known"] for r in reading.reading_levels(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").collect()}
    assert known[0] == known[1] == 24


def test_rare_and_frequent_words_alike(spark, monkeypatch):
    """The same levels whether all words are looked up or all are joined; repeated rows of a key are one document."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(pool) for _ in range(3))) for i, pool in enumerate([EASY, MIDDLE, HARD] * 12)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id int, text string")
    level = lambda: {r["key"]: (r["words"], r["known"], round(r["grade"], 6)) for r in reading.reading_levels(df, "doc_id", "text").collect()}
    monkeypatch.setattr(reading, "FREQUENT", 10**9)
    looked = level()
    monkeypatch.setattr(reading, "FREQUENT", 0)
    assert level() == looked and len(looked) == len(rows)


def test_held_out_error(spark, sf):
    from emberline.llm import queries

    got = {r["lang"]: r for r in queries.p8_error(spark, sf).collect()}
    # against always saying the mean; there are only some ninety documents here
    seeds = [min(max(r["seed_grade"], -3.0), 40.0) for r in queries.p8_levels(spark, sf).filter("lang = 'en'").collect()]
    mean = sum(seeds) / len(seeds)
    spread = sum(abs(x - mean) for x in seeds) / len(seeds)
    assert got["en"]["correlation"] > 0.9 and got["en"]["mean_error"] < 0.5 * spread

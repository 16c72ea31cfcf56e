from __future__ import annotations

from pyspark.sql import functions as F

from emberline.llm import queries, reading

EASY, HARD = "The dog can run. We saw a red bin. ", "Notwithstanding contradictory determinations, administrative authorization presupposes documentation. "


def test_languages_do_not_touch_each_other(spark):
    """English levels are the same with other languages beside them; NULL is a group of its own."""
    rows = [(i, (EASY, HARD)[i % 2] * (2 + i % 3), "en") for i in range(40)]
    other = [(100 + i, (EASY, HARD)[(i + 1) % 2] * 3, lang) for i, lang in enumerate(["es", None] * 10)] + [(200, "", "es")]
    make = lambda data: spark.createDataFrame(data, "doc_id int, text string, lang string")
    alone = {r["key"]: r["grade"] for r in reading.reading_levels(make(rows), "doc_id", "text").collect()}
    got = {r["key"]: r for r in reading.reading_levels(make(rows + other), "doc_id", "text", "lang").collect()}
    assert set(got) == {r[0] for r in rows + other} - {200}
    assert all(abs(got[k]["grade"] - g) < 1e-6 for k, g in alone.items())
    assert {k: r["lang"] for k, r in got.items()} == {k: lang for k, _, lang in rows + other if k != 200}


def test_every_document_with_words_has_a_level(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r["doc_id"], r["lang"]) for r in documents.filter(F.rlike("text", F.lit(r"\p{L}"))).collect()}
    levels = queries.p8_levels(spark, sf).select("doc_id", "lang", "grade").collect()
    assert {(r["doc_id"], r["lang"]) for r in levels} == want and len(levels) == len(want)
    assert all(r["grade"] is not None for r in levels) and {lang for _, lang in want} - {"en"}
    assert queries.p8_profile(spark, sf).agg(F.sum("n_documents")).first()[0] == len(want)

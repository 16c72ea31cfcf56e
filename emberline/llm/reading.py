"""Reading level of documents from the grades at which words are acquired.

Graded text: each document gets a first grade from the length of its sentences and words (the published grade-level
formula). A word's acquisition grade is read off its distribution over those graded texts: the grade by which the
given share of its use, per million words of each grade, has appeared. A document's level is a linear function,
calibrated on all documents, of quantiles of the grades of its known words, so that headings, lists, abbreviations and
other broken sentences cannot move it much.

Documents fall into two halves by a hash of their key, and the words of a document take their grades from the texts of the other half, as
does its calibration: no document grades the words that then grade it, so the difference between its level and its own first
grade is a held-out error (see held_out()).

All counts cover all documents. A document is read once and leaves its distinct words with their counts; frequent words, whose number is bounded by
their share, are looked up in a broadcast table, and only rare ones, none of which holds more than one part in FREQUENT of all uses, are
joined by word. A document's quantiles come from a histogram over MAX_GRADE + 1 grades, and calibration needs only sums of products.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut, staged

MAX_GRADE = 30
QUANTILES = (0.25, 0.5, 0.65, 0.75, 0.85, 0.9, 0.95)
# A word of one half of the documents with at least this part of all uses is frequent; there are at most twice as many of them.
FREQUENT = 10_000
FOLDS = 2

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]*)*")
_VOWELS = re.compile(r"[aeiouy]+")
_SILENT = re.compile(r"[aeiouy][^aeiouy\W\d_]*[^aeiouyl\W\d_]e\b", re.ASCII)
_ENDS = re.compile(r"[.!?]+[ \t\n\x0b\f\r]|\n[ \t\n\x0b\f\r]*\n")
# three words after each other: begun at the start of a word, so that long ones are read once
_THREE = re.compile(r"(?<![^ \t\n\x0b\f\r])(?:[\W\d_](?<![ \t\n\x0b\f\r]))*+[^\W\d_](?:[^ \t\n\x0b\f\r]*+[ \t\n\x0b\f\r]++[^\W\d_]){2}")


class Syllables(dict):
    """Vowel groups of a word less a silent final e, remembered for the words of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = len(_VOWELS.findall(word)) - len(_SILENT.findall(word))
        return n


def read_document(text: str | None, syllables: Syllables) -> tuple[dict[str, int], int, float | None]:
    """(count of each lower-case word, words, grade by the published formula); no grade without a word.

    Words are runs of letters, apostrophes inside. Sentences end at full stops before white space or at blank lines, and
    count if three words follow each other in them; there is at least one syllable a word.
    """
    low = (text or "").lower()
    counts = Counter(_WORD.findall(low))
    n = sum(counts.values())
    if not n:
        return counts, 0, None
    sentences = sum(1 for part in _ENDS.split(low) if _THREE.search(part))
    spoken = max(sum(c * syllables[w] for w, c in counts.items()), n)
    return counts, n, 0.39 * n / max(sentences, 1) + 11.8 * spoken / n - 15.59


def graded_documents(documents: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """key, lang, fold, words, seed (first grade), w, c (distinct words and their counts); written once, as several passes read it.

    Documents without a word leave. lang is "=" and the language, or "" where it is NULL or no column is given, so that NULL is a group like
    others. fold is the half that the key falls into.
    """
    group = F.lit("") if lang is None else F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(FOLDS)).cast("int")
    narrow = documents.select(F.col(key).alias("key"), group.alias("lang"), fold.alias("fold"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        syllables = Syllables()
        for batch in batches:
            read = [read_document(t, syllables) for t in batch["text"]]
            out = batch[["key", "lang", "fold"]].assign(
                words=[r[1] for r in read], seed=[r[2] for r in read], w=[list(r[0]) for r in read], c=[list(r[0].values()) for r in read]
            )
            yield out[out["words"] > 0]

    kind = narrow.schema["key"].dataType.simpleString()
    return staged(narrow.mapInPandas(run, f"key {kind}, lang string, fold int, words long, seed double, w array<string>, c array<int>"), "graded")


def acquisition_grades(graded: DataFrame, share: float = 0.2) -> DataFrame:
    """lang, fold, word -> grade, n: the grade by which `share` of the word's use outside the documents of `fold` has appeared.

    Use is taken per word of each grade, so that grades with much text do not count more. n counts the uses that gave the grade.
    """
    g = F.greatest(F.lit(0), F.least(F.lit(MAX_GRADE), F.round("seed"))).cast("int")
    rows = graded.select("lang", (FOLDS - 1 - F.col("fold")).alias("fold"), g.alias("g"), F.explode(F.arrays_zip("w", "c")).alias("x"))
    n = rows.groupBy("lang", "fold", F.col("x.w").alias("word"), "g").agg(F.sum("x.c").alias("n"))
    sizes = graded.groupBy("lang", (FOLDS - 1 - F.col("fold")).alias("fold"), g.alias("g")).agg(F.sum("words").alias("size"))
    # at most MAX_GRADE + 1 rows a language and half; grades of little text are damped by a floor of one part in a thousand
    sizes = sizes.withColumn("all", F.sum("size").over(Window.partitionBy("lang", "fold")))
    rated = n.join(sizes, ["lang", "fold", "g"]).withColumn("rate", F.col("n") / F.greatest(F.col("size"), F.col("all") / 1000))
    steps = rated.groupBy("lang", "fold", "word").agg(
        F.sum("n").alias("n"), F.sum("rate").alias("all"), F.array_sort(F.collect_list(F.struct("g", "rate"))).alias("r")  # at most MAX_GRADE + 1
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("at"))
    reached = F.aggregate(
        "r", start,
        lambda acc, x: F.struct((acc["sum"] + x["rate"]).alias("sum"), F.coalesce(acc["at"], F.when(acc["sum"] + x["rate"] >= share * F.col("all"), x["g"])).alias("at")),
    )
    return steps.select("lang", "fold", "word", F.coalesce(reached["at"], F.lit(MAX_GRADE)).alias("grade"), "n")


def word_quantiles(graded: DataFrame, grades: DataFrame) -> DataFrame:
    """key, lang, fold, words, seed, known, q: quantiles (QUANTILES) and mean of the grades of the document's known words.

    Rows of one key and language are one document: their words add up, their first grades are averaged.
    """
    spark = graded.sparkSession
    uses = grades.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") * FREQUENT >= F.lit(uses)
    top = {(r["lang"], r["fold"], r["word"]): r["grade"] for r in grades.filter(often).collect()}  # at most FREQUENT rows, as their uses add up
    shared = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], dict[str, int]] = {}
        for (lang, fold, word), grade in shared.value.items():
            known.setdefault((lang, fold), {})[word] = grade
        for batch in batches:
            h, rest, counts = [], [], []
            for lang, fold, ws, cs in zip(batch["lang"], batch["fold"], batch["w"], batch["c"], strict=True):
                bins, grade_of = [0] * (MAX_GRADE + 1), known.get((lang, fold), {}).get
                left, more = [], []
                for w, c in zip(ws, cs, strict=True):
                    grade = grade_of(w)
                    if grade is None:
                        left.append(w)
                        more.append(c)
                    else:
                        bins[grade] += c
                h.append(bins)
                rest.append(left)
                counts.append(more)
            yield batch[["key", "lang", "fold", "words", "seed"]].assign(h=h, w=rest, c=counts)

    kind = graded.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, lang string, fold int, words long, seed double, h array<long>, w array<string>, c array<int>"
    looked = staged(graded.mapInPandas(run, ddl), "looked")
    rare = looked.select("key", "lang", "fold", F.explode(F.arrays_zip("w", "c")).alias("x")).select("key", "lang", "fold", F.col("x.w").alias("word"), F.col("x.c").alias("c"))
    hit = rare.join(grades.filter(~often).select("lang", "fold", "word", "grade"), ["lang", "fold", "word"])
    hit = hit.groupBy("key", "lang", "fold", "grade").agg(F.sum("c").alias("c"))
    one = F.transform(F.sequence(F.lit(0), F.lit(MAX_GRADE)), lambda i: F.when(i == F.col("grade"), F.col("c")).otherwise(F.lit(0)).cast("long"))
    nothing = lambda kind: F.lit(None).cast(kind)
    both = looked.select("key", "lang", "fold", "words", "seed", "h").unionByName(
        hit.select("key", "lang", "fold", nothing("long").alias("words"), nothing("double").alias("seed"), one.alias("h"))
    )
    bins = both.groupBy("key", "lang", "fold").agg(
        F.sum("words").alias("words"), F.avg("seed").alias("seed"), F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(MAX_GRADE + 1)]).alias("h")
    )
    bins = bins.withColumn("known", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x))
    total = F.col("known").cast("double")

    def quantile(q: float) -> Column:
        """Grade at which the histogram reaches q, interpolated inside its bin."""
        steps = F.aggregate(
            F.sequence(F.lit(0), F.lit(MAX_GRADE)),
            F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("at")),
            lambda acc, i: F.struct(
                (acc["seen"] + F.element_at("h", i + 1)).alias("seen"),
                F.coalesce(
                    acc["at"],
                    F.when(
                        acc["seen"] + F.element_at("h", i + 1) >= q * total,
                        i + (q * total - acc["seen"]) / F.greatest(F.element_at("h", i + 1), F.lit(1)),
                    ),
                ).alias("at"),
            ),
        )
        return F.coalesce(steps["at"], F.lit(float(MAX_GRADE)))

    weighted = F.aggregate(F.sequence(F.lit(0), F.lit(MAX_GRADE)), F.lit(0.0), lambda acc, i: acc + i * F.element_at("h", i + 1))
    q = F.when(F.col("known") > 0, F.array(*[quantile(q) for q in QUANTILES], weighted / total))
    return bins.select("key", "lang", "fold", "words", "seed", "known", q.alias("q"))


def calibrate(rows: DataFrame, ridge: float = 1e-3) -> dict[tuple[str, int], np.ndarray]:
    """Per lang and fold the coefficients (constant first) of the seed on the quantiles, by least squares over the other fold's rows.

    Only sums of products come to the driver, a row for each language and fold. Seeds are cut to -3..MAX_GRADE + 10, against texts of one
    endless sentence. A language without a row in the other fold has no coefficients.
    """
    k = len(QUANTILES) + 2
    x = [F.lit(1.0), *[F.element_at("q", i + 1) for i in range(k - 1)]]
    y = F.greatest(F.lit(-3.0), F.least(F.lit(float(MAX_GRADE + 10)), F.col("seed")))
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * y).alias(f"y{i}") for i in range(k)]
    penalty = np.diag([0.0] + [ridge] * (k - 1))
    out = {}
    for got in rows.filter("known > 0").groupBy("lang", "fold").agg(F.count("*").alias("n"), *sums).collect():
        a, b = np.zeros((k, k)), np.array([got[f"y{i}"] for i in range(k)])
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = got[f"x{i}_{j}"]
        a /= got["n"]
        out[got["lang"], FOLDS - 1 - got["fold"]] = np.linalg.solve(a + penalty + 1e-9 * np.eye(k), b / got["n"])
    return out


def reading_levels(documents: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """key, words, known, seed_grade, grade, band (easy up to grade 5, hard from grade 13, else middle).

    documents: of one language, or with its column `lang`, which is then returned too: word grades and calibration are
    made for each language by itself, those of NULL together. Documents without a word leave; one without a known word, or whose language has no
    document in the other half, keeps its seed as its grade. Keys should be unique; repeated rows of one key are one document.
    """
    graded = graded_documents(documents, key, text, lang)
    grades = cut(acquisition_grades(graded))
    quantiles = cut(word_quantiles(graded, grades))
    names = [f"b{i}" for i in range(len(QUANTILES) + 2)]
    fitted = [(*at, *map(float, beta)) for at, beta in calibrate(quantiles).items()]
    betas = cut(documents.sparkSession.createDataFrame(fitted, "lang string, fold int, " + ", ".join(f"{n} double" for n in names)))
    level = F.col("b0")
    for i, n in enumerate(names[1:]):
        level = level + F.col(n) * F.element_at("q", i + 1)
    out = quantiles.join(betas, ["lang", "fold"], "left")
    grade = F.coalesce(level, F.col("seed"))
    return out.select(
        "key", *([] if lang is None else [F.when(F.col("lang") != "", F.substring("lang", 2, 2**31 - 1)).alias(lang)]), "words", "known",
        F.col("seed").alias("seed_grade"), grade.alias("grade"), F.when(grade < 6, "easy").when(grade >= 13, "hard").otherwise("middle").alias("band"),
    )


def held_out(levels: DataFrame, lang: str) -> DataFrame:
    """lang, n_documents, mean_error (mean absolute difference of level and first grade, both within -3..MAX_GRADE + 10), correlation.

    Both come from different documents' words, so this is a held-out error; documents without a known word do not count.
    """
    within = lambda c: F.greatest(F.lit(-3.0), F.least(F.lit(float(MAX_GRADE + 10)), F.col(c)))
    return levels.filter("known > 0").groupBy(lang).agg(
        F.count("*").alias("n_documents"), F.avg(F.abs(within("grade") - within("seed_grade"))).alias("mean_error"), F.corr(within("grade"), within("seed_grade")).alias("correlation")
    )

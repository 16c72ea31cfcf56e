"""Consensus from several annotators' labels by latent ability and difficulty.

Model: annotator i labels item j rightly with probability sigmoid(a_i * exp(b_j)), where a_i is skill (negative for
one who is wrong on purpose) and exp(b_j) is how easy the item is; a wrong label is any other class alike. Gradient
expectation-maximisation: each round finds, for the skills of the round before, every item's posterior and ease (gradient
steps inside the item's own row), then moves all skills one step along the gradient of the expected log-likelihood,
scaled by its curvature; normal priors keep both finite. Rounds end when no skill moves any more.

An item is one row with the array of its labels, written once; a round is one map over these rows and one small sum per annotator with
map-side combine, so nothing of the items is shuffled or written again. An annotator may hold any share of the labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.joins import surrogate_ids
from emberline.session import cut

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Annotators whose skills are broadcast (8 MB); beyond that they are joined.
MAX_SHARED = 1_000_000
# Steps of an item's ease within a round; each starts at 0 and rarely takes ten.
MOST_STEPS = 50


def usable_label(raw: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL from any spelling seen ("Medium risk", "crit.", "Med"); else NULL."""
    word = F.regexp_replace(F.upper(F.trim(raw)), r"[^A-Z]|RISK|LEVEL", "")
    return (
        F.when(word.isin("LOW", "L", "LO"), "LOW")
        .when(word.isin("MEDIUM", "MED", "M", "MODERATE"), "MEDIUM")
        .when(word.isin("HIGH", "H", "HI"), "HIGH")
        .when(word.isin("CRITICAL", "CRIT", "C"), "CRITICAL")
    )


def latest_labels(rows: DataFrame, item: str, annotator: str, label: str, at: str, tie: str, keep: list[str]) -> DataFrame:
    """One row per (item, annotator): the latest usable label and the columns `keep` of its row.

    rows with a NULL item or annotator, or without a usable label, leave. Rows without a time count as the earliest;
    equal times go to the greater `tie`. Repeated rows change nothing.
    """
    usable = rows.withColumn("__label", usable_label(F.col(label))).filter(
        F.col("__label").isNotNull() & F.col(item).isNotNull() & F.col(annotator).isNotNull()
    )
    latest = usable.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(
        F.max_by(F.struct(F.col("__label").alias("label"), *keep), F.struct(at, tie)).alias("r")
    )
    return latest.select("item", "annotator", "r.*")


def _posteriors(lens: np.ndarray, lab: np.ndarray, a: np.ndarray, prior: np.ndarray, rate: float) -> tuple[np.ndarray, ...]:
    """(posterior n x k, b, miss, bend, ease) of n items, whose labels lie one after another in `lab` and skills in `a`.

    Given the skills, every item's posterior and ease are found together: gradient steps of b, scaled by its curvature, each
    with a new posterior, until none moves by more than a thousandth.
    """
    n, k = len(lens), len(prior)
    of = np.repeat(np.arange(n), lens)
    b, least = np.zeros(n), 1e-6

    def state() -> tuple[np.ndarray, ...]:
        ease = np.exp(b)[of]
        s = np.clip(1 / (1 + np.exp(-a * ease)), least, 1 - least)
        wrong = np.log((1 - s) / (k - 1))
        score = np.log(prior) + np.bincount(of, wrong, n)[:, None] + np.bincount(of * k + lab, np.log(s) - wrong, n * k).reshape(n, k)
        post = np.exp(score - score.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        return post, post[of, lab] - s, s * (1 - s), ease

    for _ in range(MOST_STEPS):
        _, miss, bend, ease = state()
        step = rate * (np.bincount(of, miss * a * ease, n) - b) / (np.bincount(of, bend * (a * ease) ** 2, n) + 1)
        moved = np.clip(b + step, -2, 2)
        still = not n or np.abs(moved - b).max() < 1e-3
        b = moved
        if still:
            break
    post, miss, bend, ease = state()
    return post, b, miss, bend, ease


def _flat(column: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([np.asarray(x) for x in column]).astype(kind) if len(column) else np.zeros(0, kind)


def fit(
    labels: DataFrame, rounds: int = 100, levels: tuple[str, ...] = LEVELS, rate: float = 0.8, tolerance: float = 1e-3, shared: int = MAX_SHARED
) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of labels (item, annotator, label), at most one row per item and annotator.

    items: item, label (posterior mode; ties go to the level first in `levels`), posterior, difficulty, n. annotators:
    annotator, skill, n, residual (the last step of any skill), rounds. Rounds go on until no skill moves by more than
    `tolerance`; if `rounds` run out before, the residual tells. Up to `shared` annotators their skills are broadcast (8 bytes each);
    more are joined to the labels in every round, with the same result. An empty table gives two empty ones.
    """
    k, spark = len(levels), labels.sparkSession
    index = F.array_position(F.array(*map(F.lit, levels)), F.col("label")).cast("int") - 1
    rows = labels.select("item", "annotator", index.alias("l"))
    who = cut(surrogate_ids(rows.groupBy("annotator").agg(F.count("*").alias("n")), ["annotator"], "at", 0))
    # an item's row holds its labels, one of each annotator at most
    state = rows.join(who.select("annotator", "at"), "annotator").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "l"))).alias("x"))
    state = cut(state.select("item", F.col("x.at").alias("at"), F.col("x.l").alias("l")))
    size = who.count()
    counts = {r["l"]: r["n"] for r in state.select(F.explode("l").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
    prior = np.array([(counts.get(i, 0) + 1) / (sum(counts.values()) + k) for i in range(k)])

    def given(skills: np.ndarray | DataFrame) -> tuple[DataFrame, Callable[[pd.DataFrame], np.ndarray]]:
        """The items, and how a batch of them comes by the skills of its labels."""
        if isinstance(skills, np.ndarray):
            held = spark.sparkContext.broadcast(skills)
            return state, lambda batch: held.value[_flat(batch["at"], "int64")]
        each = state.select("item", F.posexplode(F.arrays_zip("at", "l")).alias("i", "x")).select("item", "i", F.col("x.at").alias("at"), F.col("x.l").alias("l"))
        again = each.join(skills, "at").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", "at", "l", "a"))).alias("x"))
        return again.select("item", F.col("x.at").alias("at"), F.col("x.l").alias("l"), F.col("x.a").alias("a")), lambda batch: _flat(batch["a"], "float64")

    def gradients(skills: np.ndarray | DataFrame) -> DataFrame:
        """at, up, curve: one row per annotator and task, summed over tasks."""
        rows, skill_of = given(skills)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lens = batch["at"].map(len).to_numpy()
                at, lab = _flat(batch["at"], "int64"), _flat(batch["l"], "int64")
                _, _, miss, bend, ease = _posteriors(lens, lab, skill_of(batch), prior, rate)
                seen, place = np.unique(at, return_inverse=True)
                yield pd.DataFrame({"at": seen, "up": np.bincount(place, miss * ease, len(seen)), "curve": np.bincount(place, bend * ease**2, len(seen))})

        return rows.drop("item").mapInPandas(run, "at long, up double, curve double").groupBy("at").agg(F.sum("up").alias("up"), F.sum("curve").alias("curve"))

    skills: np.ndarray | DataFrame = np.ones(size) if size <= shared else cut(who.select("at", F.lit(1.0).alias("a")))
    residual, made = 0.0, 0
    while made < rounds and size:
        made += 1
        if isinstance(skills, np.ndarray):
            got = gradients(skills).toPandas()  # at most `shared` rows
            up, curve = np.zeros(size), np.zeros(size)
            up[got["at"]], curve[got["at"]] = got["up"], got["curve"]
            step = rate * (up - (skills - 1)) / (curve + 1)
            skills, residual = skills + step, float(np.abs(step).max())
        else:
            step = rate * (F.col("up") - (F.col("a") - 1)) / (F.col("curve") + 1)
            moved = cut(skills.join(gradients(skills), "at").select("at", (F.col("a") + step).alias("a"), F.abs(step).alias("step")))
            residual = float(moved.agg(F.max("step").alias("m")).first()["m"])
            skills = moved.select("at", "a")
        if residual <= tolerance:
            break

    rows, skill_of = given(skills)
    names = np.array(levels, dtype=object)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lens = batch["at"].map(len).to_numpy()
            post, b, _, _, _ = _posteriors(lens, _flat(batch["l"], "int64"), skill_of(batch), prior, rate)
            best = np.round(post, 9).argmax(axis=1) if len(lens) else np.zeros(0, int)
            yield pd.DataFrame({"item": batch["item"], "label": names[best], "posterior": post.max(axis=1) if len(lens) else [], "difficulty": np.exp(-b), "n": lens})

    kind = state.schema["item"].dataType.simpleString()
    items = rows.mapInPandas(judge, f"item {kind}, label string, posterior double, difficulty double, n long")
    if isinstance(skills, np.ndarray):
        skills = spark.createDataFrame(pd.DataFrame({"at": np.arange(size), "a": skills}), "at long, a double")
    found = who.join(skills, "at").select("annotator", F.col("a").alias("skill"), "n", F.lit(residual).alias("residual"), F.lit(made).alias("rounds"))
    return items, found


def label_agreement(labels: DataFrame) -> DataFrame:
    """item, n, observed, agreement: share of agreeing pairs of annotators, and the same corrected for chance.

    Chance is that two labels drawn from all labels are equal. Counted from label counts, not from pairs. NULL for
    items with one label; where chance is certain (all labels of the table equal) agreement is 1.
    """
    overall = labels.groupBy("label").agg(F.count("*").cast("double").alias("m"))
    chance = F.lit(overall.agg((F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("chance")).first()["chance"]).cast("double")
    counts = labels.groupBy("item", "label").agg(F.count("*").alias("c"))
    per = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    observed = F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1)))
    per = per.withColumn("observed", observed)
    corrected = F.when(chance >= 1, F.lit(1.0)).otherwise((F.col("observed") - chance) / (1 - chance))
    return per.select("item", "n", "observed", F.when(F.col("observed").isNotNull(), corrected).alias("agreement"))


def overall_agreement(labels: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels, over items with at least two: alpha, items, labels."""
    counts = labels.groupBy("item", "label").agg(F.count("*").alias("c"))
    sized = counts.withColumn("n", F.sum("c").over(Window.partitionBy("item"))).filter("n > 1")
    per_item = sized.groupBy("item").agg(F.first("n").alias("n"), F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("off"))
    off = per_item.agg(F.sum(F.col("off") / (F.col("n") - 1)).alias("off"), F.sum("n").alias("n"), F.count("*").alias("items"))
    same = sized.groupBy("label").agg(F.sum("c").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("sq"))
    sums = off.withColumn("sq", F.lit(None).cast("long")).unionByName(
        same.select(F.lit(None).cast("double").alias("off"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("items"), "sq")
    )
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("off", "n", "items", "sq")])
    d_o = F.col("off") / F.col("n")
    d_e = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(
        F.when(d_e == 0, F.lit(1.0)).otherwise(1 - d_o / d_e).alias("alpha"), "items", F.col("n").alias("labels")
    )


def finding_agreement(rows: DataFrame) -> DataFrame:
    """item, annotators, findings, finding_agreement, corrected, of rows (item, annotator, findings array<string>).

    The chance that another annotator of the item reports a finding that one reports, over all reports; corrected by
    the same chance for reports drawn from all annotators and items. NULL array elements are ignored, a NULL array
    counts as no finding. Items with one annotator or without findings give NULL.
    """
    clean = rows.select(
        "item", "annotator",
        F.array_distinct(F.filter(F.coalesce("findings", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("f"),
    )
    n = clean.groupBy("item").agg(F.count("*").alias("annotators"))
    total = F.lit(float(clean.count()))
    c = clean.select("item", F.explode("f").alias("x")).groupBy("item", "x").agg(F.count("*").alias("c"))
    prevalence = c.groupBy("x").agg(F.sum("c").alias("m"))
    chance = F.lit(prevalence.agg((F.sum((F.col("m") / total) ** 2) / F.sum(F.col("m") / total)).alias("chance")).first()["chance"]).cast("double")
    per = c.groupBy("item").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("met"), F.sum("c").alias("findings"))
    per = n.join(per, "item", "left")
    share = F.when((F.col("annotators") > 1) & (F.col("findings") > 0), F.col("met") / (F.col("findings") * (F.col("annotators") - 1)))
    return per.select(
        "item", "annotators", F.coalesce("findings", F.lit(0)).alias("findings"), share.alias("finding_agreement"),
        F.when(chance < 1, (share - chance) / (1 - chance)).otherwise(share).alias("corrected"),
    )

"""Mixing sources to target weights by soft membership.

A classifier trained on labelled documents predicts each document's posterior over the sources. With p_ds the
membership of document d in source s (its label where it has one, else the posterior; `trust` blends the two), n_d its
tokens and r_d the rate at which it is used, the expected tokens of source s are A_s = sum_d r_d n_d p_ds. Projected
gradient descent on sum_s (A_s - t_s)^2 / 2 T_s (T_s: tokens of s) over 0 <= r_d <= its repeat limit finds rates that
meet the targets t_s as far as the limits allow. First the documents with a source are fitted, then those without one fill
what is missing. A step needs only the vector A, so each iteration is one pass over
narrow rows that sums a few numbers per task; rates are recomputed from the short history of gradients and never
shuffled. Iterations end when A no longer moves. A rate becomes whole repeats by rounding up with the probability of its fraction, drawn from a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import default_vocabulary, encoding
from emberline.session import cut

# Bounds of the dimension mix_targets, checked: its rows, and the sources named in it (posteriors are that long).
MAX_TARGETS = 100_000
MAX_SOURCES = 512
# The class of all documents whose source no mix names.
OTHER = "\0other"
_WORDS = re.compile(r"\w+")


def hashed_words(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and damped, length-normalised counts of the words of a whole text."""
    counts: dict[int, int] = {}
    for w in _WORDS.findall((text or "").lower()):
        h = zlib.crc32(w.encode()) % dims
        counts[h] = counts.get(h, 0) + 1
    index = np.fromiter(counts, dtype=np.int64, count=len(counts))
    value = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    return index, value / max(np.linalg.norm(value), 1e-9)


@dataclass(frozen=True)
class SourceModel:
    """Softmax regression over hashed words."""

    sources: tuple[str, ...]
    weights: np.ndarray  # dims x sources
    bias: np.ndarray
    held_out: float

    def posterior(self, text: str | None) -> np.ndarray:
        index, value = hashed_words(text, self.weights.shape[0])
        z = self.bias + value @ self.weights[index] if len(index) else self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


def train(
    documents: DataFrame, key: str, text: str, source: str, sources: tuple[str, ...], rows: int = 4000, dims: int = 2048
) -> SourceModel:
    """Fit on a sample of at most `rows` labelled documents (the least key hashes); a fifth of them measures accuracy.

    Hashes beyond the part of their range that the sample can take (with a fifth to spare) are left out before the sort.

    Features are computed where the documents are; only hashed counts of the sample come to the driver (at most
    `dims` numbers a row). With fewer than two sources or no labelled row every posterior is the prior.
    """
    k = len(sources)
    empty = SourceModel(sources, np.zeros((dims, k)), np.zeros(k), float("nan"))
    if k < 2:
        return empty

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            feats = [hashed_words(t, dims) for t in b["text"]]
            yield pd.DataFrame({"source": b["source"], "i": [f[0] for f in feats], "v": [f[1] for f in feats]})

    labelled = documents.filter(F.col(source).isNotNull())
    n = labelled.count()
    reach = int(2**64 * min(1.0, 1.2 * rows / max(n, 1))) - 2**63
    h = F.xxhash64(key, F.lit(17))
    sample = (
        labelled.filter(h <= F.lit(min(reach, 2**63 - 1)))
        .select(F.when(F.col(source).isin(*sources), F.col(source)).otherwise(OTHER).alias("source"), F.col(text).alias("text"), h.alias("h"))
        .orderBy("h")
        .limit(rows)
        .select("source", "text")
    )
    got = sample.mapInPandas(run, "source string, i array<bigint>, v array<double>").toPandas()
    if got.empty:
        return empty
    x = np.zeros((len(got), dims), dtype=np.float32)
    for r, (i, v) in enumerate(zip(got["i"], got["v"], strict=True)):
        x[r, np.asarray(i, dtype=np.int64)] = np.asarray(v)
    y = got["source"].map({s: j for j, s in enumerate(sources)}).to_numpy()
    test = np.arange(len(y)) % 5 == 4
    w, bias = np.zeros((dims, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    xt, target = x[~test], np.eye(k, dtype=np.float32)[y[~test]]
    momentum_w, momentum_b = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(150):
        z = xt @ w + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / max(len(xt), 1)
        momentum_w = 0.9 * momentum_w - 4.0 * (xt.T @ g + 1e-4 * w)
        momentum_b = 0.9 * momentum_b - 0.5 * g.sum(axis=0)
        w, bias = w + momentum_w, bias + momentum_b
    hit = float((np.argmax(x[test] @ w + bias, axis=1) == y[test]).mean()) if test.any() else float("nan")
    return SourceModel(sources, w.astype(np.float64), bias.astype(np.float64), hit)


def members(
    documents: DataFrame, key: str, text: str, source: str, model: SourceModel, trust: float = 1.0, vocabulary: str | None = None
) -> DataFrame:
    """key, source, labelled, n_tokens, p (membership per source, in the order of model.sources): one pass over the texts.

    Documents with a source get trust * label + (1 - trust) * posterior (their label is OTHER if the model lacks their
    source), those without one the posterior. NULL and empty texts have 0 tokens. Texts are read where they lie; only sizes and memberships leave.
    """
    path = vocabulary or default_vocabulary()
    spark = documents.sparkSession
    place = {s: j for j, s in enumerate(model.sources)}
    shared = spark.sparkContext.broadcast(model)  # dims x sources, both bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, model = encoding(path).encode_ordinary, shared.value
        for b in batches:
            ps = []
            for t, s in zip(b["text"], b["source"], strict=True):
                known = s is not None
                p = model.posterior(t) if not known or trust < 1 else np.zeros(len(place))
                if known:
                    p = (1 - trust) * p
                    p[place.get(s, place[OTHER])] += trust
                ps.append(p)
            yield pd.DataFrame(
                {"key": b["key"], "source": b["source"], "labelled": b["source"].notna(), "n_tokens": [len(encode(t)) if t else 0 for t in b["text"]], "p": ps}
            )

    narrow = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInPandas(run, f"key {kind}, source string, labelled boolean, n_tokens long, p array<double>")


@dataclass(frozen=True)
class Plan:
    """What mixing found: sources, mixes, and per mix the repeat limits, targets and history of gradients.

    Both histories are iterations of mixes x sources: that of documents with a source, and that of the others.
    """

    sources: tuple[str, ...]
    mixes: tuple[str, ...]
    limits: np.ndarray  # mixes x sources
    goal: np.ndarray  # mixes x sources: tokens
    labelled: tuple[np.ndarray, ...] = ()
    others: tuple[np.ndarray, ...] = ()
    expected: np.ndarray | None = None  # mixes x sources: tokens by membership
    settled: bool = False

    def rates(self, p: np.ndarray, m: int, labelled: bool) -> np.ndarray:
        """Rates of documents with memberships p in mix m; those with a source start at 1, the others at 0."""
        cap = p @ self.limits[m]
        r = np.clip(np.full(len(p), 1.0 if labelled else 0.0), 0, cap)
        for v in self.labelled if labelled else self.others:
            r = np.clip(r - p @ v[m], 0, cap)
        return r


def goals(targets: DataFrame, total: float) -> Plan:
    """The plan before its fit. targets: mix_name, source, target_share, max_repeats (a dimension of at most MAX_TARGETS rows, checked).

    Rows of a NULL mix or source leave; NULL shares and repeats count 0.
    """
    rows = targets.distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} rows of targets")
    rows = [r for r in rows if r["mix_name"] is not None and r["source"] is not None]
    mixes = tuple(sorted({r["mix_name"] for r in rows}))
    sources = (*sorted({r["source"] for r in rows}), OTHER)
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"the targets name more than {MAX_SOURCES - 1} sources")
    limits, goal = np.zeros((len(mixes), len(sources))), np.zeros((len(mixes), len(sources)))
    for r in rows:
        at = mixes.index(r["mix_name"]), sources.index(r["source"])
        limits[at], goal[at] = r["max_repeats"] or 0, (r["target_share"] or 0.0) * total
    return Plan(sources, mixes, limits, goal)


def solve(docs: DataFrame, plan: Plan, iterations: int = 100, tolerance: float = 1e-4) -> Plan:
    """The plan with its fit. docs: members(). `settled` tells whether A came to rest within the iterations of both fits.

    A source of a mix without documents cannot be met and is left short.
    """
    shape = (len(plan.mixes) + 1, len(plan.sources))

    def sums(plan: Plan, labelled: bool) -> np.ndarray:
        """A, mixes x sources; the last row are the tokens of each source."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = np.zeros(shape)
            for b in batches:
                if len(b):
                    p, n = np.vstack(b["p"].to_numpy()), b["n_tokens"].to_numpy(dtype=float)
                    for m in range(len(plan.mixes)):
                        a[m] += (plan.rates(p, m, labelled) * n) @ p
                    a[-1] += n @ p
            yield pd.DataFrame({"m": np.arange(len(a)), "a": list(a)})

        parts = docs.filter(F.col("labelled") == labelled).select("n_tokens", "p").mapInPandas(run, "m int, a array<double>")
        flat = parts.select("m", F.posexplode("a").alias("s", "x")).groupBy("m", "s").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(shape)
        for r in flat:
            out[r["m"], r["s"]] = r["x"]
        return out

    met, settled = np.zeros_like(plan.goal), True
    for labelled in (True, False):
        left = np.maximum(plan.goal - met, 0.0)
        got, made = sums(plan, labelled), 0
        have = np.maximum(got[-1], 1.0)
        while got[-1].any():
            step = (got[:-1] - left) / have
            plan = replace(plan, **({"labelled": (*plan.labelled, step)} if labelled else {"others": (*plan.others, step)}))
            before, got, made = got, sums(plan, labelled), made + 1
            if np.all(np.abs(got - before)[:-1] <= tolerance * np.maximum(plan.goal, 1.0)):
                break
            if made == iterations:
                settled = False
                break
        met = met + got[:-1]
    return replace(plan, expected=met, settled=settled)


def repeats(docs: DataFrame, plan: Plan) -> DataFrame:
    """mix_name, key, source, n_tokens, rate, copies: documents that a mix uses, with whole repeats.

    copies is the rate rounded up or down, up with the probability of its fraction, by a hash of mix and key; it never
    exceeds the rate's limit rounded up, and never the limit itself where that is whole.
    """
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            p, labelled = np.vstack(b["p"].to_numpy()), b["labelled"].to_numpy(dtype=bool)
            for m, name in enumerate(plan.mixes):
                r = np.where(labelled, plan.rates(p, m, True), plan.rates(p, m, False))
                chance = np.array([zlib.crc32(f"{name}|{k}".encode()) for k in b["key"]]) / 2**32
                copies = np.floor(r) + (chance < r - np.floor(r))
                used = copies > 0
                yield pd.DataFrame(
                    {"mix_name": name, "key": b["key"][used], "source": b["source"][used], "n_tokens": b["n_tokens"][used],
                     "rate": r[used], "copies": copies[used].astype("int64")}
                )

    return docs.mapInPandas(run, f"mix_name string, key {kind}, source string, n_tokens long, rate double, copies long")


def share_report(docs: DataFrame, used: DataFrame, targets: DataFrame, plan: Plan, model: SourceModel) -> DataFrame:
    """One row per row of targets: target_share, max_repeats, source_tokens, capacity, needed, expected_tokens, residual, reached_tokens,
    reached_share, used_up, short, settled, held_out.

    From the fit: expected_tokens are the tokens by membership that the rates give, residual is what they lack of the target (as a share of it).
    From the mix as it was made: reached_tokens are those of the source's own documents with their repeats, reached_share is their
    share of all tokens that the mix uses, used_up tells that each of these documents is used max_repeats times. short: used up
    and below what is needed, and by exact count: max_repeats times the source's tokens do not suffice. held_out is the classifier's accuracy.
    """
    spark = docs.sparkSession
    held = docs.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_documents"))
    total = F.lit(docs.filter("source is not null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first()["total"])
    limits = targets.distinct().groupBy("mix_name", "source").agg(F.max("max_repeats").alias("__most"))
    marked = used.filter("source is not null").join(limits, ["mix_name", "source"], "left")
    got = marked.groupBy("mix_name", "source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"), F.count_if(F.col("copies") >= F.col("__most")).alias("n_full")
    )
    size = used.groupBy("mix_name").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"))
    fitted = [(m, s, float(plan.expected[i, j])) for i, m in enumerate(plan.mixes) for j, s in enumerate(plan.sources)]
    expected = spark.createDataFrame(fitted, "mix_name string, source string, expected_tokens double")
    out = targets.distinct().join(held, "source", "left").join(got, ["mix_name", "source"], "left").join(size, "mix_name", "left").join(expected, ["mix_name", "source"], "left")
    out = out.na.fill(0, ["source_tokens", "n_documents", "reached_tokens", "n_full", "mix_tokens", "expected_tokens"])
    capacity = F.coalesce("max_repeats", F.lit(0)) * F.col("source_tokens")
    needed = F.coalesce("target_share", F.lit(0.0)) * total
    used_up = (F.col("n_full") == F.col("n_documents")) | (F.coalesce("max_repeats", F.lit(0)) == 0)
    return out.select(
        "mix_name", "source", "target_share", "max_repeats", "source_tokens", capacity.alias("capacity"), needed.alias("needed"), "expected_tokens",
        F.when(needed > 0, F.greatest((needed - F.col("expected_tokens")) / needed, F.lit(0.0))).otherwise(0.0).alias("residual"), "reached_tokens",
        F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(0.0).alias("reached_share"), used_up.alias("used_up"),
        (used_up & (F.col("reached_tokens") < needed) & (capacity < needed)).alias("short"),
        F.lit(plan.settled).alias("settled"), F.lit(model.held_out).alias("held_out"),
    )


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, trust: float = 1.0) -> tuple[DataFrame, DataFrame, SourceModel]:
    """(used documents, share report, model) for all mixes of `targets`; each mix aims at as many tokens as have a source."""
    asked = goals(targets, 1.0)
    model = train(documents, key, text, source, asked.sources)
    docs = cut(members(documents, key, text, source, model, trust))
    total = docs.filter("source is not null").agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    plan = solve(docs, replace(asked, goal=asked.goal * total))
    used = cut(repeats(docs, plan))
    return used, share_report(docs, used, targets, plan, model), model

"""Mapping freely typed values to a reference list.

Two passes over the distinct values: a multi-pattern automaton over all names and aliases finds embedded
mentions (of overlapping ones the longest stays, and the longest of all wins), and what is left goes to token-set similarity: the
share of a name's letters whose tokens are found among the value's tokens, in any order, each pair of tokens alike within a few
edits. Values that reach neither are reported as UNMATCHED.

The values are first reduced to distinct ones with map-side combine, matched in parallel, and joined back. The reference list is read in
blocks of at most MAX_NAMES labels; each block is matched by itself, and as the strength of a match does not depend on the other
names, the best over all blocks is that over the whole list.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut

UNMATCHED = "UNMATCHED"
# Labels of the reference list that are held and sent to the tasks at once.
MAX_NAMES = 200_000

# Digits that keyboards and scanners swap with letters.
LOOKALIKE = {"0": "o", "1": "l", "3": "e", "5": "s", "@": "a", "$": "s"}

_WORD = re.compile(r"[a-z0-9@$]+")
_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]|#\s*\d+")
_ABBREVIATED = re.compile(r"([^\W\d_]{2,})\.(?=\W|$)")


def tokens_of(value: str) -> tuple[list[str], set[str]]:
    """Lower-case ASCII tokens of a value, and those that a full stop abbreviates.

    Accents, brackets, running numbers and counts ("2 x") are dropped; digits inside a word are read as the letters
    they look like.
    """
    text = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    text = _BRACKETS.sub(" ", text)
    short = {m.group(1) for m in _ABBREVIATED.finditer(text)}
    out = []
    for word in _WORD.findall(text):
        if word.isdigit():
            continue
        if any(c in LOOKALIKE for c in word) and any(c.isalpha() for c in word):
            word = "".join(LOOKALIKE.get(c, c) for c in word)
        out.append(word)
    if len(out) > 1 and out[0] == "x":  # a count: "2 x sedan"
        out = out[1:]
    return out, short & set(out)


def edit_distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (swaps count one, also around other edits), or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = len(a) + len(b)
    seen: dict[str, int] = {}  # last row in which a letter of a stood
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last, held = [far, i], rows[-1], 0  # held: last column of this row where the letters were equal
        lowest = i
        for j, y in enumerate(b, 1):
            k = seen.get(y, 0)
            d = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if k and held:
                d = min(d, rows[k][held] + (i - k - 1) + 1 + (j - held - 1))
            if x == y:
                held = j
            row.append(d)
            lowest = min(lowest, d)
        seen[x] = i
        # a swap may reach back over a row or two, so give up only when two rows in a row are too far
        if lowest > most and min(last[1:]) > most:
            return most + 1
        rows.append(row)
    return rows[-1][-1]


def _grams(text: str) -> set[str]:
    padded = f"^{text}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


_PLACE = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def _letters(text: str) -> np.ndarray:
    """How often each letter and figure occurs."""
    return np.bincount([_PLACE[c] for c in text if c in _PLACE], minlength=36)


def _merged(tokens: list[str]) -> set[tuple[str, ...]]:
    """A label's tokens, and the same with one pair of neighbours written as one, or all of them, from any of them on."""
    forms = {tuple(tokens)} | {("".join(tokens[i:] + tokens[:i]),) for i in range(len(tokens))}
    forms |= {(*tokens[:i], tokens[i] + tokens[i + 1], *tokens[i + 2 :]) for i in range(len(tokens) - 1)}
    return forms


def _runs_together(word: str, tokens: list[str]) -> bool:
    """Whether the word is the tokens written as one, in any order."""
    if not tokens:
        return not word
    return any(word.startswith(t) and _runs_together(word[len(t) :], [*tokens[:i], *tokens[i + 1 :]]) for i, t in enumerate(tokens))


class Matcher:
    """names: canonical name -> its aliases. Ties between names go to the one first in alphabetical order.

    max_error: the part of a name's letters that may be missing or mistyped for a similar match.
    """

    def __init__(self, names: dict[str, list[str]], max_error: float = 0.3):
        import ahocorasick

        self.max_error = max_error
        self.names = set(names)
        self.automaton = ahocorasick.Automaton()
        spaced: dict[str, str] = {}
        self.in_any_order: dict[tuple[str, ...], str] = {}
        self.written_as_one: dict[str, list[tuple[list[str], str]]] = defaultdict(list)  # by their sorted letters
        forms: set[tuple[tuple[str, ...], str]] = set()
        self.words: set[str] = set()
        for name in sorted(names):
            for label in [name, *sorted(x for x in names[name] or [] if x)]:
                toks, _ = tokens_of(label.replace("_", " "))
                if not toks:
                    continue
                for plural in ("", "s"):
                    spaced.setdefault(f" {' '.join(toks)}{plural} ", name)
                self.in_any_order.setdefault(tuple(sorted(toks)), name)
                self.written_as_one["".join(sorted("".join(toks)))].append((toks, name))
                forms |= {(form, name) for form in _merged(toks)}
                self.words |= set(toks)
        for text, name in spaced.items():
            self.automaton.add_word(text, (len(text), name))
        self.automaton.make_automaton()
        self.forms = sorted(forms)
        self.widest = max((len(k) for k in self.in_any_order), default=1)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, (form, _) in enumerate(self.forms):
            for t in set(form):
                self.by_token[t].append(i)
        self.by_gram: dict[str, list[str]] = defaultdict(list)
        self.by_start: dict[str, list[str]] = defaultdict(list)
        self.tokens = sorted(self.by_token)
        for i, t in enumerate(self.tokens):
            for g in _grams(t):
                self.by_gram[g].append(i)
            self.by_start[t[:2]].append(t)
        self.letters = np.array([_letters(t) for t in self.tokens], dtype=np.int16).reshape(len(self.tokens), 36)
        self.most = np.array([max(1, len(t) // 2) if len(t) > 1 else 0 for t in self.tokens])
        self.alike: dict[tuple[str, bool], dict[str, int]] = {}

    def embedded(self, tokens: list[str]) -> tuple[int, str] | None:
        """(letters, name) of the longest mention; of equal ones the first. None if there is none."""
        if not self.in_any_order:
            return None
        text = f" {' '.join(tokens)} "
        found = [(-size, end - size + 1, name) for end, (size, name) in self.automaton.iter(text)] if len(self.automaton) else []
        starts = [0]
        for t in tokens:
            starts.append(starts[-1] + len(t) + 1)
        for i in range(len(tokens)):
            for j in range(i + 2, min(i + self.widest, len(tokens)) + 1):
                window = tokens[i:j]
                name = self.in_any_order.get(tuple(sorted(window))) or self.in_any_order.get(tuple(sorted([*window[:-1], window[-1].removesuffix("s")])))
                if name:
                    found.append((-(starts[j] - starts[i] + 1), starts[i], name))
        joined = "".join(tokens)
        for word in {joined, joined.removesuffix("s")}:
            found += [(-len(word) - 2, 0, name) for toks, name in self.written_as_one.get("".join(sorted(word)), ()) if _runs_together(word, toks)]
        if not found:
            return None
        size, _, name = min(found)
        return -size, name

    def _like(self, piece: str, short: bool) -> dict[str, int]:
        """Tokens of the labels that a piece of a value may stand for, with the edits between them (0 for one that it abbreviates)."""
        key = piece, short
        if key in self.alike:
            return self.alike[key]
        out: dict[str, int] = {}
        near = np.array(sorted({i for g in _grams(piece) for i in self.by_gram.get(g, ())}), dtype=int)
        if len(near):
            # each edit mends at most one letter that is missing and one that is too much
            apart = self.letters[near] - _letters(piece)
            near = near[np.maximum(np.clip(apart, 0, None).sum(axis=1), np.clip(-apart, 0, None).sum(axis=1)) <= self.most[near]]
        for i in near:
            t, most = self.tokens[i], int(self.most[i])
            d = edit_distance(piece, t, most)
            if d <= most:
                out[t] = d
        if short and len(piece) > 1:
            for t in self.by_start.get(piece[:2], ()):
                # several words written as one are not abbreviated to the start of the first
                if t not in self.words and len(piece) < 0.6 * len(t):
                    continue
                most = len(piece) // 4
                d = edit_distance(piece, t[: len(piece)], most)
                if d <= most:
                    out[t] = min(out.get(t, d), d)
        if len(self.alike) > 200_000:
            self.alike.clear()
        self.alike[key] = out
        return out

    def similar(self, tokens: list[str], short: set[str]) -> tuple[float, int, str] | None:
        """(share of a name's letters found among the tokens, its letters, name) of the best name, if the share is 1 - max_error or more.

        Pieces of the value are its tokens and any two neighbours written as one; each serves once. Of equal shares the
        longest label wins.
        """
        n = len(tokens)
        pieces = [(tokens[i], (i,), tokens[i] in short) for i in range(n)]
        pieces += [(tokens[i] + tokens[i + 1], (i, i + 1), tokens[i + 1] in short) for i in range(n - 1)]
        met: dict[str, list[tuple[int, int, tuple[int, ...]]]] = defaultdict(list)  # label token -> (edits, piece, places)
        for k, (piece, places, cut) in enumerate(pieces):
            if len(piece) <= 64:
                for t, d in self._like(piece, cut).items():
                    met[t].append((d, k, places))
        best: tuple[float, int, str] | None = None
        for i in {i for t in met for i in self.by_token[t]}:
            form, name = self.forms[i]
            letters = sum(map(len, form))
            used: set[int] = set()
            lost = 0
            for t in sorted(form, key=lambda t: (-len(t), t)):
                free = [(d, k, places) for d, k, places in met.get(t, ()) if not used & set(places)]
                # the only word of a label is abbreviated beside others only by most of its letters
                free = [x for x in free if len(form) > 1 or n == 1 or len(pieces[x[1]][0]) >= 0.6 * len(t)]
                if free:
                    d, _, places = min(free)
                    used |= set(places)
                    lost += d
                else:
                    lost += len(t)
            if len(form) == 1 and lost > max(1, int(self.max_error * letters)):
                continue
            # what is only part of a label's letters must be found whole or nearly so
            share = 1 - (lost + 0.5 * (len(used) < n and lost > 0)) / letters
            if share < 1 - self.max_error and lost > 1 or letters < 4 and lost:
                continue
            if best is None or (-share, -letters, name) < (-best[0], -best[1], best[2]):
                best = share, letters, name
        return best

    def match(self, value: str) -> tuple[str, str, float, int]:
        """(canonical name or UNMATCHED, how it was found: exact, mention, similar or none; share not found; letters found)."""
        if value in self.names:
            return value, "exact", 0.0, len(value)
        tokens, short = tokens_of(value)
        if not tokens:
            return UNMATCHED, "none", 1.0, 0
        if found := self.embedded(tokens):
            return found[1], "mention", 0.0, found[0]
        if like := self.similar(tokens, short):
            return like[2], "similar", 1 - like[0], like[1]
        return UNMATCHED, "none", 1.0, 0


@lru_cache(maxsize=4)
def _matcher(names: tuple[tuple[str, tuple[str, ...]], ...], max_error: float) -> Matcher:
    return Matcher({k: list(v) for k, v in names}, max_error)


def reference_blocks(taxonomy: DataFrame, name: str = "object_class", aliases: str = "aliases") -> list[dict[str, list[str]]]:
    """Canonical name -> aliases, in blocks of about MAX_NAMES labels by a hash of the name; most lists are one block.

    NULL and blank names are left out; names that occur twice have their aliases united. The driver holds the list; a block bounds what is
    sent to a task and held by it.
    """
    rows = taxonomy.select(F.col(name).alias("n"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(aliases, F.array().cast("array<string>")))).alias("a"))
    rows = rows.filter(F.trim("n") != "").distinct()
    parts = max(1, -(-rows.count() // MAX_NAMES))
    out = []
    for i in range(parts):
        held: dict[str, set[str]] = defaultdict(set)
        for row in rows.filter(F.pmod(F.xxhash64("n"), F.lit(parts)) == i).collect():
            held[row["n"]] |= {row["a"]} if row["a"] and row["a"].strip() else set()
        out.append({k: sorted(v) for k, v in held.items()})
    return out


def reference_list(taxonomy: DataFrame, name: str = "object_class", aliases: str = "aliases") -> dict[str, list[str]]:
    """The blocks of a list as one."""
    return {k: v for block in reference_blocks(taxonomy, name, aliases) for k, v in block.items()}


Names = dict[str, list[str]] | list[dict[str, list[str]]]


def match_values(values: DataFrame, names: Names, max_error: float = 0.3) -> DataFrame:
    """One row per distinct value of the column `value`: canonical_class, found_by (exact, mention, similar, none), error.

    names: a reference list or its blocks. Matching costs far more than its input is large, so values are spread over all cores whatever
    their size (by a hash of their own: the partitioning that distinct() leaves would be merged into few). An empty
    `names` leaves every value UNMATCHED; NULL values are dropped.
    """
    spark = values.sparkSession
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = values.select("value").filter("value is not null").distinct().repartition(width, F.xxhash64("value"))
    blocks = names if isinstance(names, list) else [names]

    def against(block: dict[str, list[str]]) -> DataFrame:
        frozen = tuple((k, tuple(v or ())) for k, v in sorted(block.items()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(frozen, max_error)
            for batch in batches:
                found = [matcher.match(v) for v in batch["value"]]
                columns = {c: [f[i] for f in found] for i, c in enumerate(("canonical_class", "found_by", "error", "letters"))}
                yield pd.DataFrame({"value": batch["value"], **columns})

        return distinct.mapInPandas(run, "value string, canonical_class string, found_by string, error double, letters int")

    out = against(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(against(block))
    if len(blocks) > 1:
        rank = F.array_position(F.array(*map(F.lit, ("none", "similar", "mention", "exact"))), F.col("found_by"))
        better = F.struct(rank, -F.col("error"), F.col("letters"))
        top = out.groupBy("value").agg(F.max(better).alias("best")).withColumnRenamed("value", "__v")
        out = out.join(top, (F.col("value") == F.col("__v")) & (better == F.col("best"))).groupBy("value").agg(
            F.min(F.struct("canonical_class", "found_by", "error")).alias("m")
        )
        out = out.select("value", "m.*")
    return out.select("value", "canonical_class", "found_by", "error")


def canonicalise(rows: DataFrame, column: str, names: Names, max_error: float = 0.3) -> DataFrame:
    """rows with canonical_class, found_by and error for every non-blank value of `column`; blank and NULL ones leave.

    The mapping has one row per distinct value and is written once; it is broadcast only when Spark finds it below the
    broadcast threshold, and otherwise joined with AQE splitting a value that holds many rows. Columns of `rows` with the names of
    the added ones are replaced.
    """
    rows = rows.drop("canonical_class", "found_by", "error").filter(F.trim(F.col(column)) != "")
    mapping = cut(match_values(rows.select(F.col(column).alias("value")), names, max_error))
    return rows.join(mapping.withColumnRenamed("value", "__value"), F.col(column) == F.col("__value")).drop("__value")

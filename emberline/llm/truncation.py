"""Finding text that was cut off, by self-joins on prefixes.

A cut value is a strict prefix of something longer, and nothing complete ends the way it ends. Values are therefore
split into clauses, figures masked, and the last clause of each value is joined by hashed fixed-length prefixes with
all clauses that occur elsewhere after the same clause before it: `going on` counts the occurrences that continue
behind the value's end, `ending` those values that stop at the same place. Where texts were complete, many others end
alike; where one was cut, nearly all others go on.

Only clause statistics are shuffled and joined, never pairs of values: each side is grouped to distinct clauses with
map-side combine first, so the join grows with the variety of the text and not with its amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import cut, staged

# What tools put behind a text that they cut.
CUT_MARKS = r"(?:\s*(?:\[[a-z .…]+\]|<[a-z .…/]+>|\((?:cut|truncated|continued|more|\.{3}|…)\)|…|\.{3,}|\uFFFD))+\s*$"
# Ends shorter than the first of these lengths meet the sums of all prefixes of their own length, so that no short prefix is a hot
# key; longer ones are looked up by the longest of these prefixes that they reach, and compared.
PREFIX_LENGTHS = (12, 24, 48, 96)
_BLANKS = " \t\r\n\u00a0"


def masked(text: Column) -> Column:
    """Figures as 0, so that texts that differ in figures only share their clauses."""
    return F.regexp_replace(text, r"\d+(?:\.\d*)?", "0")


def stripped(text: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(text, F.lit(_BLANKS))


def unmarked(text: Column) -> Column:
    """Without white space and marks for cutting at the end; only texts that end like a mark meet the pattern."""
    return _unmarked(stripped(text))


def _unmarked(bare: Column) -> Column:
    like = F.right(bare, F.lit(1)).isin("]", ">", ")", "…", "\ufffd") | F.endswith(bare, F.lit("..."))
    return F.when(like, stripped(F.regexp_replace(bare, CUT_MARKS, ""))).otherwise(bare)


def clauses(text: Column) -> Column:
    """The clauses of a text, each with its closing punctuation, empty ones left out; the first element is a mark for the beginning."""
    parts = F.split(text, r"(?<=[.,:|>()!?—;])\s+|[ \t\r]*\n\s*|(?<=;)")
    return F.concat(F.array(F.lit("^")), F.array_remove(parts, ""))


def left_open(text: Column) -> Column:
    """Whether the JSON that begins at the first brace lacks a closing brace or bracket, or stops inside a string.

    Brackets inside strings do not count, nor do those behind a quote that nothing closes.
    """
    begun = F.substring(text, F.instr(text, "{"), F.length(text))
    bare = F.regexp_replace(F.regexp_replace(begun, r"(?s)\\.", ""), r'"[^"]*"', "")
    bare = F.substring_index(bare, '"', 1)
    many = lambda b: F.length(bare) - F.length(F.replace(bare, F.lit(b), F.lit("")))
    return (many("{") > many("}")) | (many("[") > many("]"))


def _prefix(clause: Column, n: Column) -> Column:
    return F.struct(n.alias("n"), F.xxhash64(F.substring(clause, F.lit(1), n)).alias("h"))


def clause_counts(parts: DataFrame) -> DataFrame:
    """(kind, before, clause) -> ending, going: how many values stop behind the clause and how many go on.

    parts: kind, c (clauses()). Values of one kind are written alike and serve as evidence for each other. One narrow
    row per clause leaves each text, and partial aggregation reduces them to distinct clauses before the shuffle.
    """
    pairs = F.zip_with(
        F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(F.xxhash64(a).alias("before"), b.alias("clause"))
    )
    rows = parts.select("kind", (F.size("c") - 2).alias("end"), F.posexplode(pairs).alias("i", "p"))
    last = (F.col("i") == F.col("end")).cast("int")
    return rows.groupBy("kind", "p.before", "p.clause").agg(F.sum(last).alias("ending"), F.sum(1 - last).alias("going"))


def ending_evidence(counts: DataFrame, ends: DataFrame) -> DataFrame:
    """For each distinct end (kind, before, clause): ending, going, with what any clause before it gives as well.

    ends that no value has in `counts` get ending = 0. The self-join by prefix: each clause is entered under its hashed
    prefixes. Those of each short length are summed before the join (an end of that length meets one row); longer ends are looked up under
    the longest fixed prefix that they reach, and the residual test keeps what really begins with them.
    """
    ends = ends.select("kind", "before", "clause").distinct()
    short = PREFIX_LENGTHS[0] - 1

    def evidence(context: list[str], suffix: str) -> DataFrame:
        keys = ["kind", *context]
        c = counts.groupBy(*keys, "clause").agg(F.sum("ending").alias("e"), F.sum("going").alias("g"))
        at = F.transform(F.sequence(F.lit(1), F.least(F.length("clause"), F.lit(short))), lambda n: _prefix(F.col("clause"), n))
        sums = c.select(*keys, (F.col("e") + F.col("g")).alias("t"), F.explode(at).alias("x")).groupBy(*keys, "x.n", "x.h").agg(F.sum("t").alias("met"))
        fixed = F.filter(F.array(*map(F.lit, PREFIX_LENGTHS)), lambda n: n <= F.length("clause"))
        entries = c.filter(F.length("clause") > short).select(*keys, F.col("clause").alias("longer"), "e", "g", F.explode(F.transform(fixed, lambda n: _prefix(F.col("clause"), n))).alias("x"))
        entries = entries.select(*keys, "longer", "e", "g", "x.n", "x.h")
        probe = ends.select(*keys, "clause").distinct().filter(F.length("clause") > 0)
        brief = probe.filter(F.length("clause") <= short).withColumn("x", _prefix(F.col("clause"), F.length("clause")))
        brief = brief.select(*keys, "clause", "x.n", "x.h").join(sums, [*keys, "n", "h"]).join(c, [*keys, "clause"], "left").na.fill(0, ["e", "g"])
        brief = brief.select(*keys, "clause", F.col("e").alias(f"ending{suffix}"), (F.col("met") - F.col("e")).alias(f"going{suffix}"))
        long = probe.filter(F.length("clause") > short).withColumn("x", _prefix(F.col("clause"), F.array_max(fixed)))
        hit = long.select(*keys, "clause", "x.n", "x.h").join(entries, [*keys, "n", "h"]).filter(F.startswith("longer", "clause"))
        own = F.when(F.col("longer") == F.col("clause"), F.col("e")).otherwise(0)
        hit = hit.groupBy(*keys, "clause").agg(F.sum(own).alias(f"ending{suffix}"), F.sum(F.col("e") + F.col("g") - own).alias(f"going{suffix}"))
        return brief.unionByName(hit)

    near, any_before = evidence(["before"], ""), evidence([], "_any")
    joined = ends.join(near, ["kind", "before", "clause"], "left").join(any_before, ["kind", "clause"], "left")
    return joined.na.fill(0, ["ending", "going", "ending_any", "going_any"])


def find_cut(values: DataFrame, threshold: float = 0.8, few: int = 6, keep_text: bool = False) -> DataFrame:
    """values (kind and any other columns; text if keep_text) with going_share and is_cut.

    An end counts as cut when at least `threshold` of the evidence goes on behind it. A mark for cutting (CUT_MARKS)
    is no proof: the text before it is judged, once as it is and once with a full stop (where the same clause before
    is evidence enough), and one complete reading suffices. NULL and blank texts are never cut; a text of one clause that occurs nowhere else
    is not cut.

    Texts that hold a JSON object are judged by the same evidence, from other texts with one: where the object is closed, by what stands
    behind it (after a fence, or without one); where it is not (left_open), by the last clause inside it, and a bracket that is open
    counts as `few` more that go on, since every complete text goes on to close it.
    """
    values = values.drop("going_share", "is_cut")
    text = F.col("text")
    rest = [c for c in values.columns if c not in ("kind", "text")]
    rows = values.select(*rest, "kind", "text", stripped(text).alias("__bare"))
    # each of these is used more than once below, so it is a column of its own
    rows = rows.select("*", _unmarked(F.col("__bare")).alias("__whole"), F.contains(text, F.lit("{")).alias("__json"))
    whole, is_json = F.col("__whole"), F.col("__json")
    rows = rows.select("*", F.when(is_json, left_open(whole)).alias("__open"), F.when(is_json, F.substring_index(text, "{", 1)).alias("__head"))
    head = F.col("__head")
    # a fence that opens is no longer form of one that closes
    opening = F.replace(head, F.lit("```"), F.lit("~~~"))
    # what stands before a JSON object goes on; its clauses count with the prose of their kind
    material = F.when(is_json, F.concat(opening, F.lit("\n{"))).otherwise(F.nullif(whole, F.lit("")))
    # an object that is closed goes on to its end, here a last brace of its own, so only those that stop inside count as ending there
    upto = F.length(whole) - F.length(F.substring_index(whole, "}", -1))
    inside = F.concat(
        opening, F.when(F.col("__open"), F.substring(whole, F.length(head) + 1, F.length(whole))).otherwise(F.concat(F.substring(whole, F.length(head) + 1, upto - F.length(head)), F.lit("\n}")))
    )
    behind = F.concat(F.lit("}\n"), F.substring_index(whole, "}", -1))
    opened = F.when(F.contains(head, F.lit("```")), F.lit("```")).otherwise(F.lit("^"))
    rows = rows.select("*", material.alias("__m"), F.when(is_json, inside).alias("__i"), F.when(is_json, behind).alias("__e"), F.when(is_json, opened).alias("__f"))
    listed = lambda c: clauses(masked(F.col(c)))
    rows = rows.select("*", listed("__e").alias("__b"))
    ready = staged(
        rows.select(
            *rest, "kind", "__open", (whole != F.col("__bare")).alias("__marked"), listed("__m").alias("__c"), listed("__i").alias("__j"),
            F.concat(F.array("__f"), F.slice("__b", 2, F.size("__b"))).alias("__t"), *(["text"] if keep_text else []),
        ),
        "clauses",
    )
    # prose, the insides of objects and what stands behind them are evidence for their own sort only
    json_kind, tail_kind = F.concat("kind", F.lit("|inside")), F.concat("kind", F.lit("|behind"))
    lists = F.array(F.struct("kind", F.col("__c").alias("c")), F.struct(json_kind.alias("kind"), F.col("__j").alias("c")), F.struct(tail_kind.alias("kind"), F.when(~F.col("__open"), F.col("__t")).alias("c")))
    counts = cut(clause_counts(ready.select(F.inline(lists)).filter("c is not null")))
    judged = F.when(F.col("__open").isNull(), F.col("__c")).when(F.col("__open"), F.col("__j")).otherwise(F.col("__t"))
    ended = ready.withColumns(
        {
            "__kind": F.when(F.col("__open").isNull(), F.col("kind")).when(F.col("__open"), json_kind).otherwise(tail_kind),
            "__before": F.when(F.size(judged) > 1, F.xxhash64(F.try_element_at(judged, F.lit(-2)))),
            "__clause": F.when(F.size(judged) > 1, F.try_element_at(judged, F.lit(-1))),
        }
    )
    ended = ended.withColumn("__stop", F.when(F.col("__marked"), F.concat("__clause", F.lit(".")))).drop("__c", "__j", "__t", "__marked")
    found = ended.select(F.col("__kind").alias("kind"), F.col("__before").alias("before"), F.explode(F.array("__clause", "__stop")).alias("clause"))
    ends = cut(found.filter("clause is not null").distinct())
    evidence = cut(ending_evidence(counts, ends))

    near, wide = F.col("ending") + F.col("going"), F.col("ending_any") + F.col("going_any")
    first = F.when(near >= few, F.struct("going", near.alias("all"))).when(wide > 0, F.struct(F.col("going_any").alias("going"), wide.alias("all")))
    second = F.when(near >= few, F.struct("going", near.alias("all")))
    out = ended
    for column, chosen, into in (("__clause", first, "__s1"), ("__stop", second, "__s2")):
        e = evidence.select(F.col("kind").alias("__k"), F.col("before").alias("__b"), F.col("clause").alias("__e"), chosen.alias(into))
        on = (F.col("__kind") == F.col("__k")) & (F.col("__before") == F.col("__b")) & (F.col(column) == F.col("__e"))
        out = out.join(e, on, "left").drop("__k", "__b", "__e")
    more = F.when(F.coalesce("__open", F.lit(False)), F.lit(few)).otherwise(F.lit(0))

    def share(s: str) -> Column:
        return (F.coalesce(F.col(f"{s}.going"), F.lit(0)) + more) / F.greatest(F.coalesce(F.col(f"{s}.all"), F.lit(0)) + more, F.lit(1))

    going = F.least(share("__s1"), F.when(F.col("__s2").isNotNull(), share("__s2")).otherwise(share("__s1")))
    out = out.withColumn("going_share", F.when(F.col("__clause").isNull(), F.lit(0.0)).otherwise(going))
    return out.withColumn("is_cut", F.col("going_share") >= threshold).drop("__open", "__kind", "__before", "__clause", "__stop", "__s1", "__s2")

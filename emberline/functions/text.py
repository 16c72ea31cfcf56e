"""Rules over text as column expressions; rules and vocabularies are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    """True if one holds; false for none; NULL conditions count as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def contains_any(text: Column, words: Sequence[str], whole_words: bool = False) -> Column:
    """Case-insensitive substring test ("car" is in "carport"); whole_words asks for word boundaries instead."""
    low = F.lower(text)
    if whole_words:
        return any_of([F.contains(F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[^\p{L}\p{N}]+", " "), F.lit(f" {w.lower()} ")) for w in words])
    return any_of([F.contains(low, F.lit(w.lower())) for w in words])


def first_pattern(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in the lower-cased text; the default for NULL and for no match."""
    low = F.lower(text)
    out: Column | None = None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def first_category(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first keyword list of which one word is in the text."""
    out: Column | None = None
    for label, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def unless_vetoed(text: Column, cues: Sequence[str], vetoes: Sequence[str]) -> Column:
    """True if a cue and no veto is in the text."""
    return contains_any(text, cues) & ~contains_any(text, vetoes)


def mentions(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Array of the vocabulary's keys of which a word is in the text, in the vocabulary's order."""
    hits = F.array(*[F.when(contains_any(text, words), F.lit(key)) for key, words in vocabulary.items()])
    return F.filter(hits, lambda x: x.isNotNull())


def graded_match(text: Column, name: Column, aliases: Column, categories: Sequence[str], floor: float = 0.4) -> Column:
    """1.0 if the name is in the text, 0.8 for an alias, 0.6 for a category word, else the floor."""
    low = F.lower(text)
    alias = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.contains(low, F.lower(a)))
    return (
        F.when(F.contains(low, F.replace(F.lower(name), F.lit("_"), F.lit(" "))), 1.0)
        .when(F.coalesce(alias, F.lit(False)), 0.8)
        .when(contains_any(text, categories), 0.6)
        .otherwise(floor)
    )


def squeeze(text: Column, most: int | None = None) -> Column:
    """White space of any script collapsed to one blank, ends trimmed, cut to `most` characters."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return flat if most is None else F.substring(flat, 1, most)


def key_name(name: Column) -> Column:
    return F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_"))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def mapped(column: Column, table: Mapping[str, object], default: object) -> Column:
    """Look-up in a small literal table, the default for what it lacks."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def recovered_json(text: Column) -> Column:
    """The JSON text in an answer: body of a fence if there is one, from the first brace on; NULL if it parses to nothing.

    The parser stops behind the first complete value, so prose after it does no harm.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(text))
    start = F.instr(body, "{")
    candidate = F.when(start > 0, F.substring(body, start, F.length(body)))
    whole = F.when(F.try_parse_json(candidate).isNotNull(), candidate)
    upto = F.length(candidate) - F.instr(F.reverse(candidate), "}") + 1
    trimmed = F.when(F.instr(candidate, "}") > 0, F.substring(candidate, F.lit(1), upto))
    return F.coalesce(whole, F.when(F.try_parse_json(trimmed).isNotNull(), trimmed))


def sections(text: Column, boundary: str = r"\r?\n", least: int = 10) -> Column:
    """Array of (no, text): the parts between boundaries, squeezed, those shorter than `least` left out; no counts all."""
    parts = F.transform(F.split(text, boundary), lambda x, i: F.struct((i + 1).alias("no"), squeeze(x).alias("text")))
    return F.filter(parts, lambda x: F.length(x["text"]) >= least)


# The passes over the markers of a statute, captures of the id first and the text last; they overlap.
MARKERS = (
    r"(?sU)\(([a-z])\)\s+(.*?)(?=\n\([a-z]\)|\z)",
    r"(?sU)\((\d)\)\s+(.*?)(?=\n\s*\(\d\)|\n\([a-z]\)|\z)",
    r"(?sU)\((\d)\)\(([A-Z])\)\s+(.*?)(?=\(\d\)\([A-Z]\)|\n\s*\(\d\)|\z)",
)
# Fixed value: a line break before a bullet or a word with a capital.
BULLETS = r"(?U)\n(?=\s*[•●o]\s|\s{0,2}[A-Z][a-z])"


def marked_sections(text: Column, prefix: str, least: int = 16) -> Column:
    """Array of (section_id, text): what follows (letter), (digit) and (digit)(LETTER), a pass for each, squeezed.

    Ids are the prefix and what is captured, in capitals. Texts shorter than `least` leave, then only the first of each
    id stays, in the order of the passes.
    """

    def one(pattern: str, captures: int) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(captures)]
        ids = parts[0] if captures == 2 else F.zip_with(parts[0], parts[1], lambda a, b: F.concat(a, b))
        return F.zip_with(ids, parts[-1], lambda i, t: F.struct(F.concat(F.lit(prefix), F.upper(i)).alias("section_id"), squeeze(t).alias("text")))

    found = F.filter(F.concat(one(MARKERS[0], 2), one(MARKERS[1], 2), one(MARKERS[2], 3)), lambda x: F.length(x["text"]) >= least)
    ids = F.transform(found, lambda x: x["section_id"])
    return F.filter(found, lambda x, i: F.array_position(ids, x["section_id"]) == i + 1)


def bullet_chunks(text: Column, least: int = 30) -> Column:
    """Array of (no, text): the parts that begin with a bullet or a capital, those shorter than `least` left out."""
    parts = F.transform(F.split(text, BULLETS), lambda x, i: F.struct((i + 1).alias("no"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "").alias("text")))
    return F.transform(F.filter(parts, lambda x: F.length(x["text"]) >= least), lambda x: F.struct(x["no"].alias("no"), squeeze(x["text"]).alias("text")))


def plain_html(html: Column) -> Column:
    """Visible text by patterns: scripts, styles and tags dropped, common entities read. html_text() parses properly."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)

"""Queries of the text rules over documents, and of text recovery over model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import prompts, text
from emberline.operators import graph, joins, report
from emberline.plans.tables import table
from emberline.sources import readers

# Patterns of the distance zones, first match wins.
SCOPES = (
    (r"\b(5.?foot|5.?ft|0.?5|within 5)", "Zone_0"),
    (r"\b(30.?foot|30.?ft|5.?to.?30|5\s*-\s*30)", "Zone_1"),
    (r"\b(100.?foot|100.?ft|30.?to.?100|30\s*-\s*100)", "Zone_2"),
)
# Keywords of the requirement types, first match wins.
KINDS = (
    ("removal", ("remove", "clear", "eliminat")),
    ("maintenance", ("maintain", "keep", "clean")),
    ("clearance", ("within", "feet", "distance", "clearance")),
)
# What can only be seen on the ground, and what can be seen from above.
GROUND = ("vent", "mesh", "gap", "material", "rating", "class a", "fire-resistance", "flashing", "wall cover", "door gap", "soffit", "eave lining", "ember")
ABOVE = (
    "within", "feet", "zone", "propane", "firewood", "trash", "vehicle", "shed", "deck", "furniture", "mulch", "car", "boat", "rv", "ladder", "pool",
    "hot tub", "play set",
)
CATEGORIES = ("combustible material", "combustible items", "combustible object", "vegetation", "fuel", "flammable")
# Severity of a zone.
SEVERITY = {"Zone_0": "CRITICAL", "Zone_1": "HIGH", "Zone_2": "MEDIUM"}
# Words by which a rule mentions an object.
WORDS = {
    "propane_tank": ("propane tank",),
    "firewood": ("firewood", "woodpile", "wood pile", "wood stack"),
    "trash_bin": ("trash", "garbage bin", "recycle bin", "trash bin", "garbage can"),
    "mulch": ("mulch", "bark", "wood chip", "wood-chip"),
    "fence": ("fence", "fencing", "wood fence"),
    "deck": ("deck", "patio", "walking surface"),
    "patio_furniture": ("patio furniture", "furniture", "chair cushion", "chair"),
    "car": ("car", "vehicle", "parked", "automobile"),
    "rv": ("rv", "recreational vehicle"),
    "shed": ("shed", "accessory structure", "outbuilding", "adu"),
    "hot_tub": ("hot tub", "spa", "above ground pool"),
    "boat": ("boat", "watercraft"),
    "ladder": ("ladder",),
    "bbq_grill": ("bbq", "grill", "barbecue"),
    "potted_plant": ("potted plant", "planter", "pot"),
    "welcome_mat": ("door mat", "welcome mat", "mat"),
    "play_set": ("play set", "playset", "kids toy", "toy"),
    "pergola": ("pergola", "gazebo", "carport", "overhead structure"),
    "vegetation": ("vegetation", "shrub", "tree", "grass", "weed", "plant"),
    "debris": ("debris", "leaves", "needles", "dead material", "dead vegetation"),
}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def rule_scope(spark: SparkSession, sf: str) -> DataFrame:
    scope = text.first_pattern(F.col("text"), SCOPES, "ALL")
    return _docs(spark, sf).select("doc_id", scope.alias("scope"), text.mapped(scope, SEVERITY, "LOW").alias("severity"))


def rule_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(
        "doc_id", text.first_category(F.col("text"), KINDS, "structural").alias("kind"), text.unless_vetoed(F.col("text"), ABOVE, GROUND).alias("aerial")
    )


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(text.mentions(F.col("text"), WORDS), "; ").alias("mentioned"))


def squeezed(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.squeeze(F.col("text"), 200).alias("head"), F.length(text.squeeze(F.col("text"))).cast("long").alias("n"))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    """object_class, confidence, n: how many documents match the class at which confidence.

    Only pairs above the floor are formed; the floor's count is what is left of all documents.
    """
    objects = table(spark, sf, "lab_taxonomy").select("object_class", "aliases")
    rules = _docs(spark, sf).select(F.col("doc_id").alias("rule_id"), "text")
    above = graph.scored_edges(objects, rules, "governed_by", CATEGORIES, least=0.6).groupBy(F.col("src").alias("object_class"), "confidence").agg(F.count("*").alias("n"))
    total = F.lit(rules.count())
    met = above.groupBy("object_class").agg(F.sum("n").alias("met"))
    floor = objects.select("object_class").join(met, "object_class", "left").select("object_class", F.lit(0.4).alias("confidence"), (total - F.coalesce("met", F.lit(0))).alias("n"))
    return above.unionByName(floor.filter("n > 0"))


def graded_match(spark: SparkSession, sf: str) -> DataFrame:
    """Per class how many documents match it at which confidence."""
    return _graded(spark, sf)


def confidence_hist(spark: SparkSession, sf: str) -> DataFrame:
    return report.level_histogram(_graded(spark, sf), "confidence", (1.0, 0.8, 0.6, 0.4), weight="n")


def bullet_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of documents that begin with a bullet or a capital at the start of a line."""
    c = _docs(spark, sf).select("doc_id", F.explode(text.bullet_chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", F.length("c.text").cast("long").alias("n"), F.md5("c.text").alias("digest"))


def statute_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of statutes by the three passes over their markers; a statute is what a source digests, its articles lettered and numbered anew."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    lettered = F.transform(lines, lambda x, i: F.concat(F.lit("("), F.element_at(F.split(F.lit("a b c d e f g h i j"), " "), (i % 10 + 1).cast("int")), F.lit(") "), x))
    statute = F.concat(F.lit("Digest.\n"), F.array_join(lettered, "\n"))
    s = _docs(spark, sf).filter("source = 'statute_digest'").select("doc_id", F.explode(text.marked_sections(statute, "S_")).alias("s"))
    return s.select("doc_id", "s.section_id", F.length("s.text").cast("long").alias("n"))


def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of at least ten characters, repeats of the whole text left out, numbered per document."""
    s = _docs(spark, sf).select("doc_id", F.explode(text.sections(F.col("text"))).alias("s")).select("doc_id", F.col("s.no").alias("no"), F.col("s.text").alias("text"))
    first = joins.first_k(s, ["doc_id", "text"], ["no"], 1).drop("rn")
    numbered = joins.first_k(first, ["doc_id"], ["no"], 10**9, "seq")
    ids = F.format_string("%s_%03d", F.coalesce(F.upper(F.lit("sec")), F.lit("")), F.col("seq"))
    return numbered.select("doc_id", F.col("no").cast("long").alias("no"), ids.alias("section_id"), F.length("text").cast("long").alias("n"))


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The k of each event's properties, read out of a fenced answer around it."""
    wrapped = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    got = text.recovered_json(wrapped)
    return table(spark, sf, "events").select("event_id", F.get_json_object(got, "$.k").cast("long").alias("k"))


def answers_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers: whether JSON could be recovered, and the number of detections in it."""
    t = table(spark, sf, "tile_results").select("tile_id", F.col("result.raw_output").alias("raw")).filter("raw is not null").distinct()
    got = text.recovered_json(F.col("raw"))
    n = F.size(F.from_json(F.get_json_object(got, "$.detections"), "array<string>"))
    return t.select("tile_id", got.isNull().alias("parse_failed"), F.when(got.isNotNull(), F.greatest(n, F.lit(0))).cast("long").alias("n_detections"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of pages made from the documents: navigation and a script that holds a tag in a string stand around it."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><script>var a='</p>';</script><body><nav>Home</nav><main><p>"), safe, F.lit("</p></main></body></html>"))
    return _docs(spark, sf).select("doc_id", F.md5(text.squeeze(readers.html_text(page))).alias("digest"))


def html_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text by patterns, of the same documents as paragraphs."""
    page = F.concat(F.lit("<html><script>var a='</p>';</script><body><p>"), F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("</p></body></html>"))
    return _docs(spark, sf).select("doc_id", F.md5(text.plain_html(page)).alias("digest"))


def corpus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """For each word of the vocabulary: how many documents hold it, and whether any does."""
    d = _docs(spark, sf)
    flags = [F.count_if(text.contains_any(F.col("text"), words)).alias(k) for k, words in WORDS.items()]
    wide = d.agg(*flags)
    pairs = F.array(*[F.struct(F.lit(k).alias("word"), F.col(k).alias("n")) for k in WORDS])
    return wide.select(F.explode(pairs).alias("p")).select("p.word", F.col("p.n").alias("n_documents"), (F.col("p.n") > 0).alias("covered"))


def marker_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms of documents: how many there are, and how many cite a paragraph."""
    d = _docs(spark, sf).withColumn("arm", F.when(F.col("doc_id") % 2 == 0, "grounded").otherwise("plain"))
    cites = text.any_of([F.contains("text", F.lit(c)) for c in ("PRC", "IBHS", "§", "Schedule")])
    return d.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(cites).alias("n_cited"), report.share(F.count_if(cites).cast("double"), F.count("*")).alias("rate"))


def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts per parcel from its meta data: those of a known site are grounded, with rules and examples; parts that are missing are left out."""
    m = table(spark, sf, "parcel_meta").groupBy("parcel_id").agg(F.max(F.lower("site")).alias("site"), F.max("n_tiles").alias("n_tiles"))
    rules = F.concat(F.lit("Rules of "), F.col("site"), F.lit(" apply."))
    shots = F.array(F.concat(F.lit("Tile 1 of "), F.col("parcel_id")), F.lit("No objects."))
    question = F.concat(F.lit("Tiles: "), F.col("n_tiles").cast("string"))
    prompt = prompts.tile_prompt(F.concat(F.lit("Parcel "), F.col("parcel_id")), rules, shots, question, F.col("site").isNotNull())
    return m.select("parcel_id", prompt.alias("prompt"))


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lab_taxonomy")
    return t.select(
        text.display_name(F.col("object_class")).alias("shown"), text.key_name(text.display_name(F.col("object_class"))).alias("object_class"),
        F.array_join(F.slice("aliases", 1, 2), "; ").alias("first_aliases"), F.when(F.col("aerial_visible"), "YES").otherwise("no").alias("aerial"),
    )


_LOW = "lower(text)"


def _any(words: tuple[str, ...], column: str = _LOW) -> str:
    return "(" + " or ".join(f"contains({column}, '{w.lower()}')" for w in words) + ")"


_SQ = "trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
_SCOPE = "case " + " ".join(f"when regexp_matches({_LOW}, '{p}') then '{z}'" for p, z in SCOPES) + " else 'ALL' end"
_GRADE = f"""g as (
  select doc_id, object_class, case when contains({_LOW}, replace(lower(object_class), '_', ' ')) then 1.0
    when len(list_filter(aliases, lambda a: contains(lower(d.text), lower(a)))) > 0 then 0.8
    when {_any(CATEGORIES)} then 0.6 else 0.4 end::double as confidence from documents d cross join lab_taxonomy)"""

SQL = {
    "rule_scope": f"select doc_id, scope, case scope when 'Zone_0' then 'CRITICAL' when 'Zone_1' then 'HIGH' when 'Zone_2' then 'MEDIUM' else 'LOW' end as severity "
    f"from (select doc_id, {_SCOPE} as scope from documents)",
    "rule_kind": "select doc_id, case " + " ".join(f"when {_any(w)} then '{k}'" for k, w in KINDS) + f" else 'structural' end as kind, {_any(ABOVE)} and not {_any(GROUND)} as aerial from documents",
    "mentions": "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {_any(w)} then '{k}' end" for k, w in WORDS.items()) + "], lambda x: x is not null), '; ') as mentioned from documents",
    "squeezed": f"select doc_id, substr({_SQ}, 1, 200) as head, length({_SQ}) as n from documents",
    "graded_match": f"with {_GRADE} select object_class, confidence, count(*) as n from g group by 1, 2",
    "confidence_hist": f"with {_GRADE} select confidence as level, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 1) as pct from g group by 1",
    "split_sections": f"""with p as (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as text, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) as no from documents),
s as (select doc_id, no, {_SQ} as t from p), f as (select * from s where length(t) >= 10 qualify row_number() over (partition by doc_id, t order by no) = 1)
select doc_id, no, 'SEC_' || lpad((row_number() over (partition by doc_id order by no))::varchar, 3, '0') as section_id, length(t) as n from f""",
    "json_fields": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "html_text": f"select doc_id, md5(trim({_SQ})) as digest from documents",
    "corpus_coverage": " union all ".join(f"select '{k}' as word, count(*) filter ({_any(w)}) as n_documents, count(*) filter ({_any(w)}) > 0 as covered from documents" for k, w in WORDS.items()),
    "marker_arms": "select case when doc_id % 2 = 0 then 'grounded' else 'plain' end as arm, count(*) as n, "
    "count(*) filter (contains(text, 'PRC') or contains(text, 'IBHS') or contains(text, '§') or contains(text, 'Schedule')) as n_cited, "
    "round(count(*) filter (contains(text, 'PRC') or contains(text, 'IBHS') or contains(text, '§') or contains(text, 'Schedule'))::double / count(*), 4) as rate from documents group by 1",
    "prompt_text": """with m as (select parcel_id, max(lower(site)) as site, max(n_tiles) as n_tiles from parcel_meta group by 1)
select parcel_id, concat_ws(chr(10) || chr(10), 'Parcel ' || parcel_id, 'Rules of ' || site || ' apply.',
  case when site is not null then 'Example 1:' || chr(10) || 'Tile 1 of ' || parcel_id || chr(10) || chr(10) || 'Example 2:' || chr(10) || 'No objects.' end, 'Tiles: ' || n_tiles) as prompt from m""",
    "answers_parsed": r"""with t as (select distinct tile_id, result.raw_output as raw from tile_results where result.raw_output is not null),
b as (select tile_id, case when regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)```', 1) <> '' then regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)```', 1) else trim(raw) end as body from t),
c as (select tile_id, case when contains(body, '{') then substr(body, strpos(body, '{')) end as cand from b),
e as (select tile_id, cand, case when contains(cand, '}') then left(cand, length(cand) - strpos(reverse(cand), '}') + 1) end as upto from c),
j as (select tile_id, case when json_valid(cand) then cand when json_valid(upto) then upto end as js from e)
select tile_id, js is null as parse_failed, case when js is not null then coalesce(json_array_length(js, '$.detections'), 0)::bigint end as n_detections from j""",
    "html_plain": f"select doc_id, md5(trim({_SQ})) as digest from documents",
    "bullet_parts": rf"""with c as (select doc_id, unnest(string_split(regexp_replace(text, '\n(\s*[•●o]\s|\s{{0,2}}[A-Z][a-z])', chr(1) || '\1', 'g'), chr(1))) as text from documents),
t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from c)
select doc_id, length({_SQ}) as n, md5({_SQ}) as digest from t where length(text) >= 30""",
    "display_names": """select array_to_string(list_transform(string_split(object_class, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as shown,
  object_class, array_to_string(aliases[1:2], '; ') as first_aliases, case when aerial_visible then 'YES' else 'no' end as aerial from lab_taxonomy""",
}

QUERIES = {
    f.__name__: f
    for f in (
        rule_scope, rule_kind, mentions, squeezed, graded_match, confidence_hist, split_sections, bullet_parts, statute_sections, json_fields,
        answers_parsed, html_text, html_plain,
        corpus_coverage, marker_arms, prompt_text, display_names,
    )
}

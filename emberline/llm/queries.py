"""Queries over the operators of this package; queries() and oracle_sql() as the entry module expects them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.records import effective_field
from emberline.llm import canonical, consensus, cooccurrence, mixing, packing, reading, tokens, truncation
from emberline.session import cut


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1: free values to the reference list


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, canonical.Names]:
    """Each detection's class of each tile once, and the reference list."""
    names = canonical.reference_blocks(_table(spark, sf, "lab_taxonomy"))
    tiles = _table(spark, sf, "tile_results").select("tile_id", effective_field("object_class").alias("classes")).distinct()
    typed = tiles.select("tile_id", F.posexplode("classes").alias("det_no", "object_class"))
    return typed.filter(F.rlike("object_class", F.lit(r"(?U)\S"))), names


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    typed, names = _typed(spark, sf)
    free = canonical.canonicalise(typed, "object_class", names).filter("found_by <> 'exact'")
    return free.select("tile_id", "det_no", "canonical_class").distinct()


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Detections per class and how their values were matched; UNMATCHED is a class."""
    typed, names = _typed(spark, sf)
    mapped = canonical.canonicalise(typed, "object_class", names)
    return mapped.groupBy("canonical_class", "found_by").agg(
        F.count("*").alias("n_detections"), F.countDistinct("object_class").alias("n_spellings")
    )


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that stand for no class, with their counts."""
    typed, names = _typed(spark, sf)
    mapped = canonical.canonicalise(typed, "object_class", names).filter(F.col("canonical_class") == canonical.UNMATCHED)
    return mapped.groupBy("object_class").agg(F.count("*").alias("n_detections"))


# 2: consensus


def _labels(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    finding = F.transform("violations", lambda v: F.concat_ws("@", F.lower(F.trim(v["object_class"])), v["zone"]))
    rows = _table(spark, sf, "results_summary").select(
        "summary_id", "parcel_id", "annotator", "risk_label", "labelled_at", finding.alias("findings")
    )
    return cut(
        consensus.latest_labels(rows, "parcel_id", "annotator", "risk_label", "labelled_at", "summary_id", list(keep))
    )


def _judged(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, annotators with skill, annotators with their share of labels equal to the consensus of listed items)."""
    items, annotators = consensus.fit(labels.select("item", "annotator", "label"))
    items = cut(items)
    listed = items.filter("n >= 3")
    against = labels.select("item", "annotator", F.col("label").alias("own")).join(listed.select("item", "label"), "item")
    share = against.groupBy("annotator").agg(
        F.avg((F.col("own") == F.col("label")).cast("double")).alias("agreement_with_consensus"), F.count("*").alias("n_listed")
    )
    return items, annotators, share


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    items, _, share = _judged(_labels(spark, sf))
    parcels = items.filter("n >= 3").select(
        F.lit("parcel").alias("subject_kind"), F.col("item").alias("subject_id"), F.col("label").alias("verdict")
    )
    bad = share.filter("agreement_with_consensus < 0.5").select(
        F.lit("annotator").alias("subject_kind"), F.col("annotator").alias("subject_id"), F.lit("unreliable").alias("verdict")
    )
    return parcels.unionByName(bad)


def p2_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus, posterior, difficulty and both agreements of every parcel."""
    labels = _labels(spark, sf, ("findings",))
    items, _ = consensus.fit(labels.select("item", "annotator", "label"))
    found = consensus.finding_agreement(labels).select("item", "findings", "finding_agreement", F.col("corrected").alias("finding_corrected"))
    out = items.join(consensus.label_agreement(labels).select("item", "observed", "agreement"), "item").join(found, "item")
    return out.withColumnRenamed("item", "parcel_id")


def p2_annotators(spark: SparkSession, sf: str) -> DataFrame:
    labels = _labels(spark, sf)
    _, annotators, share = _judged(labels)
    return annotators.join(share, "annotator", "left")


def p2_agreement(spark: SparkSession, sf: str) -> DataFrame:
    out = consensus.overall_agreement(_labels(spark, sf))
    return out.select(F.round("alpha", 6).alias("alpha"), "items", "labels")


# 4: cut text


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """tile_id, backend, det_no, field, kind, text: every trace and raw answer of each tile once."""
    tiles = _table(spark, sf, "tile_results").select(
        "tile_id",
        "backend",
        effective_field("cot_trace").alias("traces"),
        F.col("result.raw_output").alias("raw"),
    )
    one = F.transform(F.coalesce("traces", F.array().cast("array<string>")), lambda t, i: F.struct(i.alias("det_no"), F.lit("cot_trace").alias("field"), t.alias("text")))
    raw = F.array(F.struct(F.lit(-1).alias("det_no"), F.lit("raw_output").alias("field"), F.col("raw").alias("text")))
    values = tiles.distinct().select("tile_id", "backend", F.explode(F.concat(one, raw)).alias("v"))
    return values.select("tile_id", "backend", "v.det_no", "v.field", F.lit("trace").alias("kind"), "v.text").filter("text is not null")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cut_ones = truncation.find_cut(_texts(spark, sf)).filter("is_cut")
    return cut_ones.select("tile_id", "det_no", F.col("field").alias("cut_field"))


def p4_share(spark: SparkSession, sf: str) -> DataFrame:
    """How often each backend cuts each field; blank texts do not count."""
    judged = truncation.find_cut(_texts(spark, sf).filter(F.trim("text") != ""))
    return judged.groupBy("backend", "field").agg(
        F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"),
        F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("cut_share"),
    )


# 5: co-occurrence


def _pair_table(spark: SparkSession, sf: str) -> cooccurrence.PairTable:
    """The counts after three batches: chips received up to the middle of the time covered, as their objects were first read (the last
    one of every seventh chip missing), then corrections of these, then the later chips."""
    chips = _table(spark, sf, "vlm_inference_results").select("chip_id", "detected_objects", "received_at")
    ends = chips.agg(F.min("received_at").cast("double").alias("a"), F.max("received_at").cast("double").alias("b")).first()
    middle = F.lit(((ends["a"] or 0.0) + (ends["b"] or 0.0)) / 2)
    late = F.coalesce(F.col("received_at").cast("double") > middle, F.lit(False))
    wrong = F.col("chip_id") % 7 == 0
    objects = F.col("detected_objects")
    first = F.when(wrong & (F.size(objects) > 1), F.slice(objects, F.lit(1), F.size(objects) - 1)).otherwise(objects)
    table = cooccurrence.PairTable(spark)
    table.apply(chips.filter(~late).withColumn("detected_objects", first), "chip_id", "detected_objects", "received_at")
    table.apply(chips.filter(~late & wrong), "chip_id", "detected_objects", "received_at")
    table.apply(chips.filter(late), "chip_id", "detected_objects", "received_at")
    return table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = _pair_table(spark, sf).scores(5)
    kept = scores.filter("n_ab * 500 >= n and n_ab * n >= 3 * n_a * n_b")
    return kept.select("item_a", "item_b")


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and association of every pair that occurs."""
    scores = _pair_table(spark, sf).scores()
    return scores.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("jaccard", 6).alias("jaccard")
    )


# 6: packing


def _packed(spark: SparkSession, sf: str, shares: dict[str | None, float] | None = None) -> DataFrame:
    # counted once: packing makes several passes over the sizes
    sized = cut(tokens.with_tokens(_table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text"))
    return packing.pack(sized, "doc_id", "source", "n_tokens", shares=shares)


def _first_mix(spark: SparkSession, sf: str) -> dict[str | None, float]:
    """The target shares of the mix whose name comes first; sources that it lacks come last, after a tiny share each."""
    targets = _table(spark, sf, "mix_targets").distinct()
    asked = mixing.goals(targets, 1.0)
    named = dict(zip(asked.sources[:-1], map(float, asked.goal[0]), strict=False)) if len(asked.mixes) else {}
    others = _table(spark, sf, "documents").select("source").distinct().limit(mixing.MAX_SOURCES + 1).collect()
    if len(others) > mixing.MAX_SOURCES:
        raise ValueError(f"more than {mixing.MAX_SOURCES} sources")
    return {r["source"]: max(named.get(r["source"], 0.0), 1e-6) for r in others}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.divided(_packed(spark, sf, _first_mix(spark, sf))).select(F.col("item").alias("doc_id"))


def p6_mixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each source in each window when the windows are filled to the target shares of a mix, as long as its queues last."""
    return packing.window_report(_packed(spark, sf, _first_mix(spark, sf)))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document, or each piece of one, lies."""
    return _packed(spark, sf).withColumnRenamed("item", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf))


def p6_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.window_report(_packed(spark, sf))


# 7: mixing


def _mixed(spark: SparkSession, sf: str, trust: float = 1.0) -> tuple[DataFrame, DataFrame, mixing.SourceModel]:
    documents = _table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents, _table(spark, sf, "mix_targets"), "doc_id", "text", "source", trust)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1].filter("short").select("mix_name", "source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p7_soft_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares when a label counts for four fifths of a document's membership and its text for the rest."""
    return _mixed(spark, sf, 0.8)[1]


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return _mixed(spark, sf)[0].withColumnRenamed("key", "doc_id")


# 8: reading level


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """Of all documents, each language graded by itself."""
    return reading.reading_levels(_table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    english = _table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "text")
    found = reading.reading_levels(english, "doc_id", "text").filter("words >= 30 and band <> 'middle'")
    return found.select(F.col("key").alias("doc_id"), F.col("band").alias("reading_band"))


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).withColumnRenamed("key", "doc_id")


def p8_error(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out error of the levels per language."""
    return reading.held_out(_levels(spark, sf), "lang")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words per source, language and whole grade; grades of two languages are not on one scale."""
    levels = _levels(spark, sf).select(F.col("key").alias("doc_id"), "lang", "words", "grade", "band")
    joined = levels.join(_table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source", "lang", F.round("grade").cast("int").alias("grade"), "band").agg(
        F.count("*").alias("n_documents"), F.sum("words").alias("n_words")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_BASKETS = """
baskets as (
  select chip_id, list_distinct(list_filter(list_transform(coalesce(detected_objects, []), lambda x: lower(trim(x))),
    lambda x: x is not null and x <> '')) as s
  from (select distinct chip_id, detected_objects from vlm_inference_results)
),
items as (select chip_id, unnest(s) as item from baskets),
n as (select count(distinct chip_id) as n from baskets),
single as (select item, count(*) as m from items group by item),
pair as (
  select a.item as item_a, b.item as item_b, count(*) as n_ab
  from items a join items b on a.chip_id = b.chip_id and a.item < b.item group by 1, 2
),
scored as (
  select item_a, item_b, n_ab, x.m as n_a, y.m as n_b, n.n as n
  from pair join single x on x.item = item_a join single y on y.item = item_b cross join n
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"with {_BASKETS} select item_a, item_b from scored "
        "where n_ab >= 5 and n_ab * 500 >= n and n_ab * n >= 3 * n_a * n_b",
        "p5_scores": f"with {_BASKETS} select item_a, item_b, n_ab, n_a, n_b, n, "
        "round(n_ab::double * n / (n_a::double * n_b), 6) as lift, round(n_ab::double / (n_a + n_b - n_ab), 6) as jaccard from scored",
        "p2_agreement": """
with usable as (
  select *, regexp_replace(upper(trim(risk_label)), '[^A-Z]|RISK|LEVEL', '', 'g') as w from results_summary
), named as (
  select summary_id, parcel_id, annotator, labelled_at,
    case when w in ('LOW', 'L', 'LO') then 'LOW' when w in ('MEDIUM', 'MED', 'M', 'MODERATE') then 'MEDIUM'
      when w in ('HIGH', 'H', 'HI') then 'HIGH' when w in ('CRITICAL', 'CRIT', 'C') then 'CRITICAL' end as label
  from usable
), latest as (
  select parcel_id, annotator, label from named where label is not null and parcel_id is not null and annotator is not null
  qualify row_number() over (partition by parcel_id, annotator order by labelled_at desc nulls last, summary_id desc) = 1
), counts as (select parcel_id, label, count(*) as c from latest group by 1, 2
), sized as (select *, sum(c) over (partition by parcel_id) as n from counts qualify n > 1
), items as (select parcel_id, max(n) as n, sum(c * (n - c)) as off from sized group by 1
), d as (select sum(off::double / (n - 1)) as off, sum(n)::double as n, count(*) as items from items
), same as (select sum(m::double * m) as sq from (select sum(c) as m from sized group by label))
select round(1 - (off / n) / ((n * n - sq) / (n * (n - 1))), 6) as alpha, items, n::bigint as labels from d, same
""",
    }

"""Queries over tile results: unnesting, scores, counts, profiles, agreement, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import boxes, score, text
from emberline.functions.records import effective_structs
from emberline.operators import graph, joins, report, suppress, vote
from emberline.plans.tables import table

ZONES = ("Zone_0", "Zone_1", "Zone_2")
# Categories of what a picture cannot show, first match wins.
LIMITATIONS = (
    ("canopy_occlusion", ("canopy", "tree cover", "occluded by tree", "canopy shadow", "overhang")),
    ("shadow_ambiguity", ("shadow", "shading", "cast shadow")),
    ("vertical_clearance", ("vertical", "height", "clearance", "distance above")),
    ("object_type_uncertainty", ("material", "plastic vs metal", "cannot confirm", "type unclear", "ambiguous")),
    ("proximity_measurement", ("exact distance", "feet from", "proximity", "measure distance")),
    ("interior_not_visible", ("interior", "inside", "inside home", "not visible from above")),
    ("temporal", ("when", "time of", "red flag day", "evacuation")),
)
# Aliases of the focused classes, in order.
ALIASES = {
    "propane_tank": ("propane", "lpg", "gas tank", "bbq tank", "liquid propane", "cylinder"),
    "trash_can": ("garbage bin", "waste bin", "recycle bin", "plastic bin", "garbage can", "trash bin"),
    "vehicle": ("car", "truck", "van", "pickup", "suv", "automobile", "rv", "boat"),
    "wood_pile": ("firewood", "woodpile", "lumber stack", "log pile", "stacked wood"),
    "storage_shed": ("shed", "outbuilding", "structure"),
}
CITATIONS = ("PRC", "IBHS", "§", "Ordinance", "Rule")

_DET_SQL = """
tiles as (select distinct * from tile_results),
eff as (
  select tile_id, parcel_id, model, backend, zone as tile_zone, try_cast(tile_row as bigint) as tile_row,
    try_cast(tile_col as bigint) as tile_col, elapsed_s,
    case when len(result.detections) > 0 then result.detections else detections end as d,
    coalesce(result.overall_parcel_risk, overall_parcel_risk) as risk,
    coalesce(result.parse_failed, parse_failed, false) as failed,
    coalesce(result.aerial_limitations, aerial_limitations) as limits
  from tiles
),
raw as (select * exclude (d, limits), unnest(d) as x, generate_subscripts(d, 1) - 1 as det_no from eff),
det as (
  select tile_id, parcel_id, model, backend, tile_row, tile_col, risk, det_no, coalesce(nullif(trim(x.object_class), ''), 'unknown') as object_class,
    coalesce('Zone_' || nullif(regexp_extract(coalesce(x.zone, tile_zone), '([012])', 1), ''), 'Zone_2') as zone,
    coalesce(x.compliance_status, 'UNKNOWN') as compliance_status, coalesce(x.severity, 'NONE') as severity,
    coalesce(x.confidence, 'LOW') as confidence, x.bounding_box_pixels as box, x.cot_trace as cot_trace
  from raw
)
"""


def tiles(spark: SparkSession, sf: str, columns: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """Each tile once: tile_id, the columns asked for, and d, the detections with the fields asked for.

    Nested and flat forms are united. Repeated rows are identical, so equal rows are dropped; what is not asked for is
    left out before that and so not read.
    """
    known = {
        "tile_zone": F.col("zone"),
        "tile_row": F.expr("try_cast(tile_row as bigint)"),
        "tile_col": F.expr("try_cast(tile_col as bigint)"),
        "risk": F.coalesce("result.overall_parcel_risk", "overall_parcel_risk"),
        "failed": F.coalesce("result.parse_failed", "parse_failed", F.lit(False)),
        "limits": F.coalesce("result.aerial_limitations", "aerial_limitations"),
    }
    chosen = [known.get(c, F.col(c)).alias(c) for c in columns]
    if fields:
        chosen.append(effective_structs(fields).alias("d"))
    return table(spark, sf, "tile_results").select("tile_id", *chosen).distinct()


def detections(spark: SparkSession, sf: str, *fields: str, columns: Sequence[str] = ("parcel_id",)) -> DataFrame:
    """One row per detection: tile_id, det_no, the tile columns and fields asked for, defaults filled in, zones spelt alike."""
    t = tiles(spark, sf, [*columns, *(["tile_zone"] if "zone" in fields else [])], fields)
    x = t.select("*", F.posexplode("d").alias("det_no", "x")).drop("d")
    digit = F.regexp_extract(F.coalesce("x.zone", "tile_zone"), "([012])", 1) if "zone" in fields else F.lit("")
    known = {
        "object_class": lambda: F.coalesce(F.nullif(F.trim("x.object_class"), F.lit("")), F.lit("unknown")),
        "zone": lambda: F.when(digit != "", F.concat(F.lit("Zone_"), digit)).otherwise("Zone_2"),
        "compliance_status": lambda: F.coalesce("x.compliance_status", F.lit("UNKNOWN")),
        "severity": lambda: F.coalesce("x.severity", F.lit("NONE")),
        "confidence": lambda: F.coalesce("x.confidence", F.lit("LOW")),
        "bounding_box_pixels": lambda: F.col("x.bounding_box_pixels"),
        "cot_trace": lambda: F.col("x.cot_trace"),
    }
    names = {"bounding_box_pixels": "box"}
    kept = [known[f]().alias(names.get(f, f)) for f in fields]
    return x.select("tile_id", "det_no", *columns, *kept)


def effective_detections(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf, "object_class", "zone", "compliance_status", "severity", "confidence", "bounding_box_pixels").select(
        "tile_id", F.col("det_no").cast("long").alias("det_no"), "object_class", "zone", "compliance_status", "severity", "confidence",
        boxes.is_box(F.col("box")).alias("has_box"),
    )


def _score_a(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf, "object_class", "zone", "compliance_status", "severity")
    return score.zone_score(d, "parcel_id", "compliance_status", "zone", "severity", "object_class")


def risk_score_a(spark: SparkSession, sf: str) -> DataFrame:
    return _score_a(spark, sf)


def top_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _score_a(spark, sf).orderBy(F.desc("score"), "parcel_id").limit(10)


def risk_score_b(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf, "compliance_status", "severity", columns=("parcel_id", "risk")).withColumn("risk", F.upper(F.trim("risk")))
    return score.tally_score(d, "parcel_id", "compliance_status", "severity", "risk")


def violation_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    hit = detections(spark, sf, "object_class", "compliance_status").filter("compliance_status = 'VIOLATION'").withColumn("k", text.key_name(F.col("object_class")))
    out = score.breakdown(hit, "parcel_id", "k")
    entries = F.transform(F.map_entries("breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("parcel_id", F.array_join(entries, ", ").alias("breakdown"))


def worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    order = {"NONE": 0, "REVIEW": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
    return detections(spark, sf, "severity").groupBy("parcel_id").agg(score.worst("severity", order).alias("worst_severity"))


def class_zone_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.pivot_counts(detections(spark, sf, "object_class", "zone"), "object_class", "zone", ZONES)


def severity_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return report.pivot_counts(detections(spark, sf, "zone", "severity"), "zone", "severity", ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"))


def composite_counts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("compliance_status") == "VIOLATION", F.concat(F.lit("VIOLATION:"), F.col("zone"))).otherwise(F.col("compliance_status"))
    return detections(spark, sf, "zone", "compliance_status").groupBy(key.alias("node_kind")).agg(F.count("*").alias("n"))


def model_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles, failed parses, tiles without detections per model; guarded shares."""
    t = tiles(spark, sf, ("model", "parcel_id", "failed"), ("object_class",)).withColumn("n", F.coalesce(F.greatest(F.size("d"), F.lit(0)), F.lit(0)))
    return t.groupBy("model").agg(
        F.count("*").alias("n_tiles"), F.count_if("failed").alias("n_failed"), F.count_if(F.col("n") == 0).alias("n_empty"),
        F.sum("n").alias("n_detections"), report.share(F.sum("n").cast("double"), F.count("*")).alias("per_tile"),
        F.countDistinct("parcel_id").alias("n_parcels"),
    )


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    return tiles(spark, sf, ("backend", "failed", "elapsed_s")).groupBy("backend").agg(
        F.count_if(~F.col("failed")).alias("n_ok"), F.count_if("failed").alias("n_failed"),
        F.round(F.sum("elapsed_s"), 2).alias("seconds"),
        report.share(F.sum("elapsed_s"), F.count_if(~F.col("failed")), 3).alias("seconds_per_ok"),
    )


def zone_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf, "zone", "compliance_status")
    return report.detection_profile(d, "zone", F.col("compliance_status") == "VIOLATION", "parcel_id")


def site_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per site (of parcel_meta, else the first three characters of the parcel): counts and the distinct severities."""
    meta = table(spark, sf, "parcel_meta").filter("site is not null").groupBy("parcel_id").agg(F.min(F.lower("site")).alias("site"))
    d = detections(spark, sf, "severity").join(meta, "parcel_id", "left").withColumn("site", F.coalesce("site", F.substring("parcel_id", 1, 3)))
    return d.groupBy("site").agg(
        F.count("*").alias("n"), F.countDistinct("parcel_id").alias("n_parcels"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.array_join(F.array_sort(F.collect_set("severity")), ", ").alias("severities"),
    )


def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Backends as arms: detections per tile and share of traces that cite a clause."""
    cites = F.size(F.filter("d", lambda x: text.any_of([F.contains(x["cot_trace"], F.lit(c)) for c in CITATIONS])))
    marker = F.coalesce(F.greatest(cites, F.lit(0)), F.lit(0))
    return report.ablation(tiles(spark, sf, ("backend",), ("cot_trace",)), "backend", "d", marker)


def limitation_categories(spark: SparkSession, sf: str) -> DataFrame:
    lim = tiles(spark, sf, ("limits",)).select(F.explode("limits").alias("l")).filter("l is not null")
    n = lim.groupBy(text.first_category(F.col("l"), LIMITATIONS, "other").alias("category")).agg(F.count("*").alias("n"))
    return n


def _model_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf, "object_class", "zone", "compliance_status", "severity", columns=("parcel_id", "model"))
    pick = lambda m: score.zone_score(d.filter(F.col("model") == m), "parcel_id", "compliance_status", "zone", "severity", "object_class")
    return pick("tessera-vl"), pick("ovlm-7b")


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _model_labels(spark, sf)
    return report.agreement_rate(report.agreement(a, b, "parcel_id", "risk_label", ("LOW", "MEDIUM", "HIGH", "CRITICAL")))


def top_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _model_labels(spark, sf)
    pairs = report.agreement(a, b, "parcel_id", "risk_label", ("LOW", "MEDIUM", "HIGH", "CRITICAL"))
    return pairs.withColumn("span", F.col("span").cast("long")).orderBy(F.desc("span"), "parcel_id").limit(10)


def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    labels = detections(spark, sf, "object_class").select("object_class").distinct()
    return graph.resolve_alias(labels, "object_class", ALIASES)


def vote_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every tile of a parcel as an answer about it, numbered by tile_id; numbered over all parcels at once, as one may hold a tenth of the rows."""
    t = joins.surrogate_ids(tiles(spark, sf, ("parcel_id",)).filter("parcel_id is not null"), ["parcel_id", "tile_id"], "at", 0)
    n = t.groupBy("parcel_id").agg(F.count("*").alias("responses"), F.min("at").alias("first"))
    resp = t.join(n, "parcel_id").select("tile_id", "responses", (F.col("at") - F.col("first")).alias("resp"))
    d = detections(spark, sf, "object_class", "compliance_status", "severity", "confidence").join(resp, "tile_id").withColumnRenamed("det_no", "det")
    voted = vote.vote(d.drop("tile_id"), "parcel_id", "responses")
    return voted.withColumn("first_resp", F.col("first_resp").cast("long"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Detections with boxes in image coordinates (tiles are 512 wide with a stride of 256) and a confidence rank."""
    d = detections(spark, sf, "object_class", "confidence", "bounding_box_pixels", columns=("parcel_id", "tile_row", "tile_col")).filter("tile_row is not null and tile_col is not null")
    return d.select(
        "parcel_id", "tile_id", F.col("det_no").cast("long").alias("det_no"), text.key_name(F.col("object_class")).alias("label"),
        boxes.translate(F.col("box"), F.col("tile_col") * 256.0, F.col("tile_row") * 256.0).alias("box"),
        (-text.mapped(F.col("confidence"), {"LOW": 0, "MEDIUM": 1, "HIGH": 2}, 0)).alias("rank"),
    )


def nms(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression within parcel and label."""
    kept = suppress.suppress(_placed(spark, sf), ["parcel_id", "label"], "box", ["rank", "tile_id", "det_no"])
    return kept.select("parcel_id", "label", "tile_id", "det_no")


def nms_in_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same by rounds over a grid join, as groups of any size are decided."""
    kept = suppress.suppress(_placed(spark, sf), ["parcel_id", "label"], "box", ["rank", "tile_id", "det_no"], most=0)
    return kept.select("parcel_id", "label", "tile_id", "det_no")


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression within the parcel whatever the class."""
    kept = suppress.suppress(_placed(spark, sf), ["parcel_id"], "box", ["rank", "tile_id", "det_no"])
    return kept.groupBy("parcel_id").agg(F.count("*").alias("n_kept"), F.sum("tile_id").alias("tile_sum"))


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every two detections of a tile that overlap, with both positions; paired inside the row, so only tiles are shuffled."""
    t = tiles(spark, sf, (), ("bounding_box_pixels",)).select("tile_id", F.transform("d", lambda x: x["bounding_box_pixels"]).alias("all"))
    first = t.select("*", F.posexplode("all").alias("det_no", "box"))
    rest = F.slice("all", F.col("det_no") + 2, F.size("all"))
    pairs = first.select("tile_id", "det_no", "box", F.posexplode(rest).alias("after", "other_box"))
    v = F.round(boxes.iou(F.col("box"), F.col("other_box")), 6)
    other = F.col("det_no") + F.col("after") + 1
    return pairs.select("tile_id", F.col("det_no").cast("long").alias("det_no"), other.cast("long").alias("other_no"), v.alias("iou")).filter("iou > 0")


def box_transforms(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf, "bounding_box_pixels", columns=("tile_row", "tile_col")).filter(boxes.is_box(F.col("box")) & F.col("tile_row").isNotNull() & F.col("tile_col").isNotNull())
    at = boxes.translate(F.col("box"), F.col("tile_col") * 256.0, F.col("tile_row") * 256.0)
    grown = boxes.expand(F.col("box"), F.lit(12.0), F.lit(512), F.lit(512))
    part = boxes.to_percent(boxes.to_xywh(F.col("box")), F.lit(512.0), F.lit(512.0))
    return d.select(
        "tile_id", F.col("det_no").cast("long").alias("det_no"), F.get(at, F.lit(0)).alias("image_x0"), F.get(at, F.lit(3)).alias("image_y1"),
        boxes.area(F.col("box")).alias("area"), F.get(grown, F.lit(0)).alias("grown_x0"), F.get(grown, F.lit(2)).alias("grown_x1"),
        F.round(F.get(part, F.lit(2)), 4).alias("w_pct"),
    )


def box_cover(spark: SparkSession, sf: str) -> DataFrame:
    """How many boxes touch each 128-pixel cell of their tile."""
    d = detections(spark, sf, "bounding_box_pixels").filter(boxes.is_box(F.col("box")))
    c = [boxes.corner(F.col("box"), i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    own = d.select("tile_id", F.concat_ws("-", "tile_id", "det_no").alias("id"), *c)
    step = F.array(*[F.lit(i) for i in range(4)])
    cells = d.select("tile_id").distinct().select("tile_id", F.explode(step).alias("r"), F.lit(0).alias("z")).select("tile_id", "r", F.explode(step).alias("q"))
    cells = cells.select(
        "tile_id", (F.col("r") * 4 + F.col("q")).cast("long").alias("id"), (F.col("q") * 128.0).alias("x0"), (F.col("r") * 128.0).alias("y0"),
        ((F.col("q") + 1) * 128.0).alias("x1"), ((F.col("r") + 1) * 128.0).alias("y1"),
    )
    return joins.covering(own, cells, 128.0, by=["tile_id"]).groupBy("tile_id").agg(F.count("*").alias("n"))


_SCORED = """
scored as (
  select parcel_id, model, case when compliance_status = 'VIOLATION' then
      (case zone when 'Zone_0' then 3 when 'Zone_1' then 2 else 1 end) *
      (case severity when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 when 'LOW' then 0 when 'NONE' then 0 else 1 end)
      else 0 end as s, compliance_status = 'VIOLATION' as hit, object_class from det
)
"""
_LABEL = "case when score <= 0 then 'LOW' when score <= 4 then 'MEDIUM' when score <= 9 then 'HIGH' else 'CRITICAL' end"
_SCORE_A = f"""
score_a as (
  select *, {_LABEL} as risk_label from (
    select parcel_id, sum(s)::bigint as score, count(*) filter (hit) as violation_count,
      count(distinct object_class) filter (hit) as n_classes from scored group by parcel_id)
)
"""


def _labels_sql() -> str:
    return f"""with {_DET_SQL}, {_SCORED},
per as (select parcel_id, model, sum(s) as score from scored where model in ('tessera-vl', 'ovlm-7b') group by 1, 2),
lab as (select parcel_id, model, {_LABEL} as l from per),
both_ as (
  select a.parcel_id, a.l as label_a, b.l as label_b from lab a join lab b on a.parcel_id = b.parcel_id
  where a.model = 'tessera-vl' and b.model = 'ovlm-7b')
"""


def _limits_sql() -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains(lower(l), '{w}')" for w in words) + f" then '{name}'" for name, words in LIMITATIONS
    )
    return f"""with {_DET_SQL}, lim as (select unnest(limits) as l from eff)
select case {cases} else 'other' end as category, count(*) as n from lim where l is not null group by 1"""


def _alias_sql() -> str:
    low = "trim(lower(object_class))"
    exact = " ".join(f"when {low} = '{n}' then '{n}'" for n in ALIASES)
    equal = " ".join(f"when {low} in ({', '.join(repr(w) for w in ws)}) then '{n}'" for n, ws in ALIASES.items())
    part = " ".join(
        f"when {low} <> '' and (contains({low}, '{n.replace('_', ' ')}') or "
        + " or ".join(f"contains({low}, '{w}') or contains('{w}', {low})" for w in ws)
        + f") then '{n}'"
        for n, ws in ALIASES.items()
    )
    return f"with {_DET_SQL} select object_class, case {exact} {equal} {part} else object_class end as canonical from (select distinct object_class from det)"


_IOU = """
  case when len(box) >= 4 and len(next_box) >= 4 and
      (box[3]-box[1])*(box[4]-box[2]) + (next_box[3]-next_box[1])*(next_box[4]-next_box[2]) > 0
    then greatest(least(box[3], next_box[3]) - greatest(box[1], next_box[1]), 0)
       * greatest(least(box[4], next_box[4]) - greatest(box[2], next_box[2]), 0)
     / ((box[3]-box[1])*(box[4]-box[2]) + (next_box[3]-next_box[1])*(next_box[4]-next_box[2])
        - greatest(least(box[3], next_box[3]) - greatest(box[1], next_box[1]), 0)
        * greatest(least(box[4], next_box[4]) - greatest(box[2], next_box[2]), 0))
    else 0 end
"""
_CITED = " or ".join(f"contains(x.cot_trace, '{c}')" for c in CITATIONS)

def overlap_sql(q: str, x: str) -> str:
    """Intersection over union of two boxes given as lists; NULL for two empty ones."""
    side = lambda b, i: f"greatest({b}[{i + 2}] - {b}[{i}], 0)"
    cut = lambda i: f"greatest(least({q}[{i + 2}], {x}[{i + 2}]) - greatest({q}[{i}], {x}[{i}]), 0)"
    inter = f"({cut(1)} * {cut(2)})"
    return f"({inter} / nullif({side(q, 1)} * {side(q, 2)} + {side(x, 1)} * {side(x, 2)} - {inter}, 0))"


def greedy_sql(placed: str, group: str, order: str, columns: str, threshold: float = 0.5) -> str:
    """Common table expressions that end in `kept`: the rows of `placed` (with `box`) that greedy suppression keeps, box by box."""
    return f"""ranked as (select *, len(list_filter(box[1:4], lambda v: v is not null)) = 4 as good, dense_rank() over (order by {group}) as g from {placed}),
numbered as (select *, row_number() over (partition by g order by {order}) as k from ranked where good),
step as (
  select distinct g, 0::bigint as k, []::struct(b double[], k bigint)[] as held from numbered
  union all
  select s.g, s.k + 1, case when len(list_filter(s.held, lambda q: coalesce({overlap_sql("q.b", "r.box")}, 0) > {threshold})) > 0 then s.held
    else list_append(s.held, {{'b': r.box, 'k': r.k}}) end
  from step s join numbered r on r.g = s.g and r.k = s.k + 1),
best as (select g, arg_max(held, k) as held from step group by 1),
chosen as (select g, unnest(held).k as k from best),
kept as (select {columns} from numbered join chosen using (g, k) union all select {columns} from ranked where not coalesce(good, false))
"""


_PLACED = f"""{_DET_SQL},
placed as (
  select parcel_id, tile_id, det_no, replace(trim(lower(object_class)), ' ', '_') as label,
    [box[1] + tile_col * 256.0, box[2] + tile_row * 256.0, box[3] + tile_col * 256.0, box[4] + tile_row * 256.0]::double[] as box,
    case confidence when 'MEDIUM' then -1 when 'HIGH' then -2 else 0 end as rank
  from det where tile_row is not null and tile_col is not null)"""

SQL = {
    "nms": f"""with recursive {_PLACED}, {greedy_sql("placed", "parcel_id, label", "rank, tile_id, det_no", "parcel_id, label, tile_id, det_no")}
select * from kept""",
    "nms_in_rounds": f"""with recursive {_PLACED}, {greedy_sql("placed", "parcel_id, label", "rank, tile_id, det_no", "parcel_id, label, tile_id, det_no")}
select * from kept""",
    "greedy_dedup": f"""with recursive {_PLACED}, {greedy_sql("placed", "parcel_id", "rank, tile_id, det_no", "parcel_id, tile_id")}
select parcel_id, count(*) as n_kept, sum(tile_id)::bigint as tile_sum from kept group by 1""",
    "effective_detections": f"with {_DET_SQL} select tile_id, det_no, object_class, zone, compliance_status, severity, confidence, "
    "coalesce(len(list_filter(box[1:4], lambda v: v is not null)) = 4, false) as has_box from det",
    "risk_score_a": f"with {_DET_SQL}, {_SCORED}, {_SCORE_A} select * from score_a",
    "top_risk": f"with {_DET_SQL}, {_SCORED}, {_SCORE_A} select * from score_a order by score desc, parcel_id limit 10",
    "risk_score_b": f"""with {_DET_SQL}, r as (
  select parcel_id, count(*) filter (compliance_status = 'VIOLATION') as violation_count,
    count(*) filter (compliance_status = 'VIOLATION' and severity = 'CRITICAL') as c,
    count(*) filter (compliance_status = 'VIOLATION' and severity = 'HIGH') as h,
    coalesce(max(case upper(trim(risk)) when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 else 0 end), 0) as rk
  from det group by parcel_id)
select parcel_id, violation_count + 2 * c + h as score, violation_count,
  case rk when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as risk_label from r""",
    "violation_breakdown": f"""with {_DET_SQL}, c as (
  select parcel_id, replace(trim(lower(object_class)), ' ', '_') as k, count(*) as n from det
  where compliance_status = 'VIOLATION' group by 1, 2)
select parcel_id, string_agg(k || '=' || n, ', ' order by k) as breakdown from c group by 1""",
    "worst_severity": f"""with {_DET_SQL}, r as (
  select parcel_id, severity, case severity when 'NONE' then 0 when 'REVIEW' then 0 when 'LOW' then 1 when 'MEDIUM' then 2
    when 'HIGH' then 3 when 'CRITICAL' then 4 else -1 end as k from det)
select parcel_id, arg_max(severity, (k, severity)) as worst_severity from r group by 1""",
    "class_zone_counts": f"""with {_DET_SQL} select object_class, count(*) filter (zone = 'Zone_0') as "Zone_0",
  count(*) filter (zone = 'Zone_1') as "Zone_1", count(*) filter (zone = 'Zone_2') as "Zone_2", count(*) as total from det group by 1""",
    "severity_crosstab": f"""with {_DET_SQL} select zone, count(*) filter (severity = 'CRITICAL') as "CRITICAL",
  count(*) filter (severity = 'HIGH') as "HIGH", count(*) filter (severity = 'MEDIUM') as "MEDIUM",
  count(*) filter (severity = 'LOW') as "LOW", count(*) filter (severity = 'NONE') as "NONE", count(*) as total from det group by 1""",
    "composite_counts": f"""with {_DET_SQL} select case when compliance_status = 'VIOLATION' then 'VIOLATION:' || zone
  else compliance_status end as node_kind, count(*) as n from det group by 1""",
    "model_conditions": f"""with {_DET_SQL}, t as (select *, coalesce(len(d), 0) as k from eff)
select model, count(*) as n_tiles, count(*) filter (failed) as n_failed, count(*) filter (k = 0) as n_empty, sum(k)::bigint as n_detections,
  round(sum(k)::double / count(*), 4) as per_tile, count(distinct parcel_id) as n_parcels from t group by 1""",
    "throughput": f"""with {_DET_SQL} select backend, count(*) filter (not failed) as n_ok, count(*) filter (failed) as n_failed,
  round(sum(elapsed_s), 2) as seconds,
  round(case when count(*) filter (not failed) > 0 then sum(elapsed_s) / count(*) filter (not failed) else 0 end, 3) as seconds_per_ok
  from eff group by 1""",
    "zone_profile": f"""with {_DET_SQL} select zone, count(*) as n, count(*) filter (compliance_status = 'VIOLATION') as flagged,
  round(100 * avg((compliance_status = 'VIOLATION')::int::double), 1) as flagged_pct, count(distinct parcel_id) as n_groups from det group by 1""",
    "site_profile": f"""with {_DET_SQL}, meta as (select parcel_id, min(lower(site)) as site from parcel_meta where site is not null group by 1)
select coalesce(meta.site, substr(det.parcel_id, 1, 3)) as site, count(*) as n, count(distinct det.parcel_id) as n_parcels,
  count(*) filter (severity = 'CRITICAL') as n_critical, string_agg(distinct severity, ', ' order by severity) as severities
from det left join meta on det.parcel_id = meta.parcel_id group by 1""",
    "ablation": f"""with {_DET_SQL}, c as (select backend, count(*) filter ({_CITED}) as cited from raw group by 1),
t as (select backend, count(*) as n_tiles, sum(coalesce(len(d), 0))::bigint as n_detections from eff group by 1)
select t.backend, n_tiles, n_detections, round(n_detections::double / n_tiles, 4) as per_tile, coalesce(cited, 0) as n_cited,
  round(case when n_detections > 0 then coalesce(cited, 0)::double / n_detections else 0 end, 4) as cited_rate
from t left join c on t.backend = c.backend""",
    "limitation_categories": _limits_sql(),
    "agreement": _labels_sql() + """select count(*) as n_both, count(*) filter (label_a = label_b) as n_agree,
  round(case when count(*) > 0 then count(*) filter (label_a = label_b)::double / count(*) else 0 end, 4) as agree_rate from both_""",
    "top_disagreements": _labels_sql() + """, k as (select *, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], label_a) as ra,
  list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], label_b) as rb from both_)
select parcel_id, label_a, label_b, abs(ra - rb)::bigint as span from k order by span desc, parcel_id limit 10""",
    "alias_resolve": _alias_sql(),
    "vote_tiles": f"""with {_DET_SQL},
k as (select parcel_id, tile_id, row_number() over (partition by parcel_id order by tile_id) - 1 as resp from eff),
n as (select parcel_id, count(*) as responses from k group by 1),
one as (
  select d.parcel_id, k.resp, d.object_class, d.compliance_status as s, d.severity as v, d.confidence as c
  from det d join k on d.tile_id = k.tile_id
  qualify row_number() over (partition by d.parcel_id, k.resp, d.object_class order by d.det_no) = 1),
cls as (select parcel_id, object_class, min(resp) as first_resp from one group by 1, 2),
grid as (select cls.*, n.responses, unnest(range(n.responses)) as resp from cls join n using (parcel_id)),
full_ as (
  select g.parcel_id, g.object_class, g.first_resp, g.responses, g.resp, coalesce(s, 'UNCERTAIN') as s, coalesce(v, 'NONE') as v,
    case coalesce(c, 'LOW') when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end as c
  from grid g left join one o on g.parcel_id = o.parcel_id and g.object_class = o.object_class and g.resp = o.resp),
s1 as (select parcel_id, object_class, s, count(*) as n, min(resp) as at_ from full_ group by 1, 2, 3),
s2 as (select parcel_id, object_class, arg_max(s, (n, -at_)) as s, count(*) as kinds from s1 group by 1, 2),
v1 as (select parcel_id, object_class, v, count(*) as n, min(resp) as at_ from full_ group by 1, 2, 3),
v2 as (select parcel_id, object_class, arg_max(v, (n, -at_)) as v from v1 group by 1, 2),
l as (select parcel_id, object_class, first_resp, responses, min(c) as c from full_ group by 1, 2, 3, 4),
f as (
  select l.parcel_id, l.object_class, l.first_resp, s2.s, v2.v, l.c, s2.kinds = l.responses and l.responses > 1 as flagged
  from l join s2 using (parcel_id, object_class) join v2 using (parcel_id, object_class))
select parcel_id, object_class, first_resp, case when flagged then 'UNCERTAIN' else s end as compliance_status, v as severity,
  case when flagged then 'LOW' when c = 2 then 'HIGH' when c = 1 then 'MEDIUM' else 'LOW' end as confidence, flagged,
  not bool_or(flagged) over (partition by parcel_id) as all_agree from f""",
    "iou_pairs": f"""with {_DET_SQL}, p as (
  select a.tile_id, a.det_no, b.det_no as other_no, a.box, b.box as next_box from det a join det b on a.tile_id = b.tile_id and b.det_no > a.det_no)
select * from (select tile_id, det_no, other_no, round({_IOU}, 6) as iou from p) where iou > 0""",
    "box_transforms": f"""with {_DET_SQL} select tile_id, det_no, box[1] + tile_col * 256.0 as image_x0, box[4] + tile_row * 256.0 as image_y1,
  greatest(box[3] - box[1], 0) * greatest(box[4] - box[2], 0) as area, greatest(box[1] - 12, 0) as grown_x0, least(box[3] + 12, 512) as grown_x1,
  round(100 * (box[3] - box[1]) / 512, 4) as w_pct from det
where len(list_filter(box[1:4], lambda v: v is not null)) = 4 and tile_row is not null and tile_col is not null""",
    "box_cover": f"""with {_DET_SQL}, b as (select tile_id, box from det where len(list_filter(box[1:4], lambda v: v is not null)) = 4 and box[3] > box[1] and box[4] > box[2]),
c as (select q * 128.0 as x0, r * 128.0 as y0, (q + 1) * 128.0 as x1, (r + 1) * 128.0 as y1 from range(4) qs(q), range(4) rs(r))
select tile_id, count(*) as n from b join c on box[1] < x1 and x0 < box[3] and box[2] < y1 and y0 < box[4] group by 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        effective_detections, risk_score_a, top_risk, risk_score_b, violation_breakdown, worst_severity, class_zone_counts,
        severity_crosstab, composite_counts, model_conditions, throughput, zone_profile, site_profile, ablation,
        limitation_categories, agreement, top_disagreements, alias_resolve, vote_tiles, nms, nms_in_rounds, greedy_dedup, iou_pairs,
        box_transforms, box_cover,
    )
}

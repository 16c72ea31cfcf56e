"""Queries over screened chips, parcels and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import boxes, score, text
from emberline.operators import joins, raster, report
from emberline.plans.tables import table

ORDER = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def chips(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Each chip once, with the columns asked for; copies are identical. What is not asked for is not read.

    objects are the detected objects without blank and NULL elements, spellings united.
    """
    clean = F.filter(F.transform("detected_objects", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    objects = F.coalesce(F.array_distinct(clean), F.array().cast("array<string>")).alias("objects")
    return table(spark, sf, "vlm_inference_results").select("chip_id", *[objects if c == "objects" else F.col(c) for c in columns]).distinct()


def findings(spark: SparkSession, sf: str) -> DataFrame:
    c = chips(spark, sf, "parcel_id", "compliance_findings").select("chip_id", "parcel_id", F.posexplode("compliance_findings").alias("no", "f")).filter("f is not null")
    return c.select(
        "chip_id", "parcel_id", F.col("no").cast("long").alias("finding_no"), F.lower(F.trim("f.object_class")).alias("object_class"),
        F.col("f.zone").alias("zone"), F.col("f.clip_score").alias("clip_score"), F.size(F.coalesce("f.violations", F.expr("slice(f.violations, 1, 0)"), F.expr("cast(array() as array<struct<violation_id: string, severity: string, detection: string>>)"))).cast("long").alias("n_violations"),
        F.col("f.top_violation").alias("top_violation"), F.col("f.severity").alias("severity"),
    )


def chip_findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).withColumn("clip_score", F.round("clip_score", 4))


def chip_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Per parcel: chips, chips with violations and their share, distinct objects, worst severity (NONE if none)."""
    c = chips(spark, sf, "parcel_id", "has_violations", "max_severity", "objects")
    rank = F.max(text.mapped(F.col("max_severity"), ORDER, 0))
    base = c.groupBy("parcel_id").agg(
        F.count("*").alias("n_chips"), F.count_if("has_violations").alias("n_flagged"),
        F.round(100 * F.avg(F.coalesce("has_violations", F.lit(False)).cast("double")), 1).alias("flagged_pct"), rank.alias("r"),
    )
    objects = c.select("parcel_id", F.explode("objects").alias("o")).groupBy("parcel_id").agg(
        F.countDistinct("o").alias("n_objects"), F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("objects")
    )
    names = F.array(*map(F.lit, ORDER))
    out = base.join(objects, "parcel_id", "left")
    return out.select(
        "parcel_id", "n_chips", "n_flagged", "flagged_pct", F.coalesce("n_objects", F.lit(0)).alias("n_objects"),
        F.coalesce("objects", F.lit("")).alias("objects"), F.element_at(names, F.col("r") + 1).alias("worst"),
    )


def chip_zones(spark: SparkSession, sf: str) -> DataFrame:
    c = chips(spark, sf, "zone", "has_violations", "parcel_id")
    return report.detection_profile(c, "zone", F.col("has_violations"), "parcel_id")


def chip_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five best scored classes of each chip as text, from its findings."""
    from emberline.functions.vectors import top_string

    best = findings(spark, sf).groupBy("chip_id", F.col("object_class").alias("class")).agg(F.max("clip_score").alias("score"))
    return top_string(best.filter("score is not null"), "chip_id")


def class_scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest score of each of five classes per chip, one column per class."""
    f = findings(spark, sf)
    names = ("dry_weed_patch", "raised_deck", "refuse_cart", "motorhome", "shade_sail")
    cols = [F.round(F.max(F.when(F.col("object_class") == n, F.col("clip_score"))), 4).alias(n) for n in names]
    return f.filter(F.col("object_class").isin(*names)).groupBy("chip_id").agg(*cols)


def detected_and_found(spark: SparkSession, sf: str) -> DataFrame:
    """Per class the chips that detect it and the chips that find a violation for it; either may be missing."""
    seen = chips(spark, sf, "objects").select("chip_id", F.explode("objects").alias("object_class")).groupBy("object_class").agg(F.count("*").alias("n_detected"))
    found = findings(spark, sf).filter("n_violations > 0").groupBy("object_class").agg(F.countDistinct("chip_id").alias("n_found"))
    out = seen.join(found, "object_class", "full").na.fill(0, ["n_detected", "n_found"])
    return out.withColumn("found_pct", F.round(F.when(F.col("n_detected") > 0, 100.0 * F.col("n_found") / F.col("n_detected")).otherwise(0.0), 1))


def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by id and severity, from the nested arrays."""
    c = chips(spark, sf, "compliance_findings").select(F.explode("compliance_findings").alias("f")).select(F.explode("f.violations").alias("v"))
    return c.filter("v is not null").groupBy(F.col("v.violation_id").alias("violation_id"), F.col("v.severity").alias("severity")).agg(F.count("*").alias("n"))


def any_critical(spark: SparkSession, sf: str) -> DataFrame:
    """Chips of which one finding is critical, counted by zone, with the mean number of findings."""
    c = chips(spark, sf, "zone", "compliance_findings").withColumn("n", F.greatest(F.coalesce(F.size("compliance_findings"), F.lit(0)), F.lit(0)))
    hit = F.coalesce(F.exists("compliance_findings", lambda f: f["severity"] == "CRITICAL"), F.lit(False))
    return c.groupBy("zone").agg(F.count_if(hit).alias("n_critical"), F.round(F.avg(F.col("n").cast("double")), 4).alias("mean_findings"))


def breakdown_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Per parcel the class counts of its summaries, later summaries winning per class: size and sum of the merged map.

    The maps are unnested and the last value per class taken by an aggregation, so no parcel's summaries are gathered.
    """
    r = table(spark, sf, "results_summary").select("summary_id", "parcel_id", "detection_breakdown").filter("parcel_id is not null and detection_breakdown is not null")
    entries = r.select("parcel_id", "summary_id", F.explode_outer("detection_breakdown").alias("k", "v"))
    last = entries.groupBy("parcel_id", "k").agg(F.max_by(F.coalesce("v", F.lit(0)), "summary_id").alias("v"))
    return last.groupBy("parcel_id").agg(F.count("k").alias("n_classes"), F.sum(F.when(F.col("k").isNotNull(), F.col("v")).otherwise(0)).cast("long").alias("total"))


def tagged_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries' violations with a source tag and defaults in every element, counted."""
    from emberline.functions.records import defaults, tagged

    r = table(spark, sf, "results_summary").select("summary_id", "violations").distinct()
    v = r.select("summary_id", F.explode(defaults(tagged(F.col("violations"), "imagery_source", "aerial"), {"confidence": "LOW", "zone": "Zone_2"})).alias("v"))
    return v.groupBy(F.col("v.imagery_source").alias("source"), F.col("v.confidence").alias("confidence"), F.col("v.zone").alias("zone")).agg(F.count("*").alias("n"))


def parcel_meta_once(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "parcel_meta")
    return m.groupBy("parcel_id").agg(
        F.max("gsd_cm").alias("gsd_cm"), F.max(F.get("dims_px", F.lit(0))).alias("h"), F.max(F.get("dims_px", F.lit(1))).alias("w"),
        F.max("building_bbox_px").alias("building"), F.max("n_tiles").alias("n_tiles"),
    )


def _grid(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    g = raster.tile_grid(parcel_meta_once(spark, sf), "parcel_id", "h", "w", 512, 256, mode)
    return g.groupBy("parcel_id").agg(F.count("*").alias("n"), F.max("y0").cast("long").alias("last_y"), F.max("x0").cast("long").alias("last_x"), F.sum("x0").alias("sum_x"))


def tile_grid_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf, "pad")


def tile_grid_snap(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf, "snap")


def tile_grid_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf, "drop")


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    m = parcel_meta_once(spark, sf).filter(boxes.is_box(F.col("building").cast("array<double>")))
    px = [boxes.feet_to_pixels(ft, F.col("gsd_cm")).alias(f"r{i}") for i, ft in enumerate((5.0, 30.0, 100.0))]
    return m.select("parcel_id", "h", "w", F.col("building").cast("array<double>").alias("b"), *px)


def zone_by_box(spark: SparkSession, sf: str) -> DataFrame:
    """Zone of each tile centre of a parcel's grid by nested boxes around the building; tiles outside leave."""
    r = _rings(spark, sf)
    g = raster.tile_grid(r, "parcel_id", "h", "w", 512, 256, "drop").join(r.drop("h", "w"), "parcel_id")
    rings = [(f"Zone_{i}", boxes.expand(F.col("b"), F.col(f"r{i}").cast("double"), F.lit(1e9), F.lit(1e9))) for i in range(3)]
    zone = boxes.zone_of_point(F.col("x0") + 256.0, F.col("y0") + 256.0, rings)
    return g.withColumn("zone", zone).filter("zone is not null").groupBy("parcel_id", "zone").agg(F.count("*").alias("n"))


def zone_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Zone of each tile centre by its distance from the building's centre less half a tile."""
    r = _rings(spark, sf)
    g = raster.tile_grid(r, "parcel_id", "h", "w", 512, 256, "drop").join(r.drop("h", "w"), "parcel_id")
    dx = F.col("x0") + 256.0 - (boxes.corner(F.col("b"), 0) + boxes.corner(F.col("b"), 2)) / 2
    dy = F.col("y0") + 256.0 - (boxes.corner(F.col("b"), 1) + boxes.corner(F.col("b"), 3)) / 2
    zone = boxes.zone_by_distance(dx, dy, [(f"Zone_{i}", F.col(f"r{i}").cast("double")) for i in range(3)], F.lit(256.0))
    return g.withColumn("zone", zone).filter("zone is not null").groupBy("parcel_id", "zone").agg(F.count("*").alias("n"))


def manifest_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of the upscaled manifest: row and column from the file name, new suffix, a quarter of the ground distance."""
    t = table(spark, sf, "tile_results").select("tile_id", "tile_path", F.expr("try_cast(gsd_cm as double)").alias("gsd")).distinct()
    stem = F.regexp_extract("tile_path", r"([^/]+)\.png$", 1)
    return t.select(
        "tile_id", F.regexp_replace("tile_path", r"\.png$", "_sr4.png").alias("tile_path"), F.split_part(stem, F.lit("_"), F.lit(1)).alias("parcel_id"),
        F.regexp_extract(stem, r"_r(\d+)_c", 1).cast("long").alias("row"), F.regexp_extract(stem, r"_c(\d+)$", 1).cast("long").alias("col"),
        F.round(F.col("gsd") / 4, 2).alias("gsd_cm"),
    )


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels with meta data that no annotator has summarised."""
    done = table(spark, sf, "results_summary").select("parcel_id")
    return joins.pending(table(spark, sf, "parcel_meta").select("parcel_id").distinct(), done, ["parcel_id"])


def default_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with the ground distance and tile count of their parcel, defaults where the parcel is unknown."""
    t = table(spark, sf, "tile_results").select("tile_id", "parcel_id").distinct()
    m = parcel_meta_once(spark, sf).select("parcel_id", F.round("gsd_cm", 3).alias("gsd_cm"), F.col("n_tiles").cast("long").alias("n_tiles"))
    return joins.with_default(t, m, ["parcel_id"], {"gsd_cm": 0.0, "n_tiles": 0})


def summary_worst(spark: SparkSession, sf: str) -> DataFrame:
    """Per parcel the worst risk label among its summaries and its greatest score."""
    r = table(spark, sf, "results_summary").drop("detection_breakdown").withColumn("l", F.upper(F.trim("risk_label"))).filter(F.col("l").isin(*ORDER))
    return r.groupBy("parcel_id").agg(score.worst("l", ORDER).alias("worst_label"), F.max("score").cast("long").alias("best_score"))


def surrogate_images(spark: SparkSession, sf: str) -> DataFrame:
    """Dense image ids over all tile paths in order, and the number of detections that point to each."""
    t = table(spark, sf, "tile_results").select("tile_path").filter("tile_path is not null").distinct()
    return joins.surrogate_ids(t, ["tile_path"], "image_id")


def label_batches(spark: SparkSession, sf: str) -> DataFrame:
    from emberline.sources.writers import label_tasks

    ids = surrogate_images(spark, sf)
    return label_tasks(ids, "image_id", 500).groupBy("batch_no").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id"))


def status_checklist(spark: SparkSession, sf: str) -> DataFrame:
    names = ("lab_taxonomy", "parcel_meta", "tile_results", "vlm_inference_results", "results_summary", "documents")
    return report.checklist([(n, table(spark, sf, n)) for n in names])


_CHIP = """
c0 as (select * exclude (received_at, stamp) from vlm_inference_results),
c1 as (select distinct * from c0),
chip as (select *, coalesce(list_distinct(list_filter(list_transform(detected_objects, lambda x: lower(trim(x))), lambda x: x is not null and x <> '')), []) as objects from c1),
f0 as (select chip_id, parcel_id, generate_subscripts(compliance_findings, 1) - 1 as finding_no, unnest(compliance_findings) as f from chip),
finding as (
  select chip_id, parcel_id, finding_no, lower(trim(f.object_class)) as object_class, f.zone as zone, f.clip_score as clip_score,
    coalesce(len(f.violations), 0) as n_violations, f.top_violation as top_violation, f.severity as severity from f0 where f is not null)
"""
_META = """
meta as (
  select parcel_id, max(gsd_cm) as gsd_cm, max(dims_px[1]) as h, max(dims_px[2]) as w, max(building_bbox_px) as building, max(n_tiles) as n_tiles
  from parcel_meta group by 1)
"""


def _grid_sql(mode: str) -> str:
    ends = {"pad": "range(0, greatest(e - 512, 0) + 1, 256)", "drop": "case when e >= 512 then range(0, e - 512 + 1, 256) else [] end"}
    ends["snap"] = "list_distinct(list_concat(range(0, greatest(e - 512, 0) + 1, 256), [greatest(e - 512, 0)]))"
    y, x = ends[mode].replace("e - 512", "h - 512").replace("e >=", "h >="), ends[mode].replace("e - 512", "w - 512").replace("e >=", "w >=")
    return f"""with {_META}, ys as (select parcel_id, w, unnest({y}) as y0 from meta where h > 0 and w > 0),
g as (select parcel_id, y0, unnest({x}) as x0 from ys)
select parcel_id, count(*) as n, max(y0)::bigint as last_y, max(x0)::bigint as last_x, sum(x0)::bigint as sum_x from g group by 1"""


_RINGS = f"""with {_META}, ring as (
  select parcel_id, h, w, building as b, case when gsd_cm > 0 then trunc(5 * 30.48 / gsd_cm) else 0 end as r0,
    case when gsd_cm > 0 then trunc(30 * 30.48 / gsd_cm) else 0 end as r1, case when gsd_cm > 0 then trunc(100 * 30.48 / gsd_cm) else 0 end as r2
  from meta where len(building) >= 4 and len(list_filter(building[1:4], lambda v: v is not null)) = 4 and h >= 512 and w >= 512),
ys as (select *, unnest(range(0, h - 512 + 1, 256)) + 256.0 as y from ring), g as (select *, unnest(range(0, w - 512 + 1, 256)) + 256.0 as x from ys)
"""

SQL = {
    "chip_findings": f"with {_CHIP} select * exclude (clip_score), round(clip_score, 4) as clip_score from finding",
    "chip_parcels": f"""with {_CHIP}, b as (
  select parcel_id, count(*) as n_chips, count(*) filter (has_violations) as n_flagged,
    round(100 * avg(coalesce(has_violations, false)::int::double), 1) as flagged_pct,
    max(case max_severity when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 else 0 end) as r from chip group by 1),
o as (select parcel_id, count(distinct o) as n_objects, string_agg(distinct o, ', ' order by o) as objects
  from (select parcel_id, unnest(objects) as o from chip) group by 1)
select b.parcel_id, n_chips, n_flagged, flagged_pct, coalesce(n_objects, 0) as n_objects, coalesce(objects, '') as objects,
  case r when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as worst
from b left join o on b.parcel_id = o.parcel_id""",
    "chip_zones": f"""with {_CHIP} select zone, count(*) as n, count(*) filter (has_violations) as flagged,
  round(100 * avg(coalesce(has_violations, false)::int::double), 1) as flagged_pct, count(distinct parcel_id) as n_groups from chip group by 1""",
    "chip_top5": f"""with {_CHIP}, s as (select chip_id, object_class, max(clip_score) as score from finding group by 1, 2),
r as (select *, row_number() over (partition by chip_id order by score desc, object_class) as rn from s where score is not null)
select chip_id, string_agg(object_class || '=' || printf('%.3f', score + 1e-9), ', ' order by rn) as top from r where rn <= 5 group by 1""",
    "class_scores_wide": f"""with {_CHIP} select chip_id, """
    + ", ".join(f"round(max(clip_score) filter (object_class = '{n}'), 4) as {n}" for n in ("dry_weed_patch", "raised_deck", "refuse_cart", "motorhome", "shade_sail"))
    + " from finding where object_class in ('dry_weed_patch', 'raised_deck', 'refuse_cart', 'motorhome', 'shade_sail') group by 1",
    "detected_and_found": f"""with {_CHIP}, s as (select o as object_class, count(*) as n_detected from (select unnest(objects) as o from chip) group by 1),
v as (select object_class, count(distinct chip_id) as n_found from finding where n_violations > 0 group by 1)
select coalesce(s.object_class, v.object_class) as object_class, coalesce(n_detected, 0) as n_detected, coalesce(n_found, 0) as n_found,
  round(case when coalesce(n_detected, 0) > 0 then 100.0 * coalesce(n_found, 0)::double / n_detected else 0 end, 1) as found_pct
from s full join v on s.object_class = v.object_class""",
    "violation_counts": f"""with {_CHIP}, v as (select unnest(f.violations) as v from f0)
select v.violation_id as violation_id, v.severity as severity, count(*) as n from v where v is not null group by 1, 2""",
    "any_critical": f"""with {_CHIP} select zone,
  count(*) filter (len(list_filter(compliance_findings, lambda f: f.severity = 'CRITICAL')) > 0) as n_critical,
  round(avg(coalesce(len(compliance_findings), 0)::double), 4) as mean_findings from chip group by 1""",
    "tile_grid_pad": _grid_sql("pad"),
    "tile_grid_snap": _grid_sql("snap"),
    "tile_grid_drop": _grid_sql("drop"),
    "zone_by_box": _RINGS + """, z as (select parcel_id, case
  when x between greatest(b[1] - r0, 0) and b[3] + r0 and y between greatest(b[2] - r0, 0) and b[4] + r0 then 'Zone_0'
  when x between greatest(b[1] - r1, 0) and b[3] + r1 and y between greatest(b[2] - r1, 0) and b[4] + r1 then 'Zone_1'
  when x between greatest(b[1] - r2, 0) and b[3] + r2 and y between greatest(b[2] - r2, 0) and b[4] + r2 then 'Zone_2' end as zone from g)
select parcel_id, zone, count(*) as n from z where zone is not null group by 1, 2""",
    "zone_by_distance": _RINGS + """, d as (select *, sqrt((x - (b[1] + b[3]) / 2) * (x - (b[1] + b[3]) / 2) + (y - (b[2] + b[4]) / 2) * (y - (b[2] + b[4]) / 2)) - 256 as d from g),
z as (select parcel_id, case when d <= r0 then 'Zone_0' when d <= r1 then 'Zone_1' when d <= r2 then 'Zone_2' end as zone from d)
select parcel_id, zone, count(*) as n from z where zone is not null group by 1, 2""",
    "manifest_rescale": """with t as (select distinct tile_id, tile_path, try_cast(gsd_cm as double) as gsd from tile_results),
s as (select *, regexp_extract(tile_path, '([^/]+)\\.png$', 1) as stem from t)
select tile_id, regexp_replace(tile_path, '\\.png$', '_sr4.png') as tile_path, split_part(stem, '_', 1) as parcel_id,
  regexp_extract(stem, '_r(\\d+)_c', 1)::bigint as row, regexp_extract(stem, '_c(\\d+)$', 1)::bigint as col, round(gsd / 4 + 1e-9, 2) as gsd_cm from s""",
    "resume_pending": "select distinct parcel_id from parcel_meta m where not exists (select 1 from results_summary r where r.parcel_id = m.parcel_id)",
    "default_offsets": f"""with {_META} select t.tile_id, t.parcel_id, coalesce(round(gsd_cm, 3), 0) as gsd_cm, coalesce(n_tiles, 0)::bigint as n_tiles
from (select distinct tile_id, parcel_id from tile_results) t left join meta m on t.parcel_id = m.parcel_id""",
    "breakdown_merged": """with e as (select parcel_id, summary_id, unnest(map_entries(detection_breakdown)) as e from results_summary where parcel_id is not null and detection_breakdown is not null),
l as (select parcel_id, e.key as k, arg_max(coalesce(e.value, 0), summary_id) as v from e group by 1, 2),
p as (select distinct parcel_id from results_summary where parcel_id is not null and detection_breakdown is not null)
select p.parcel_id, count(k) as n_classes, coalesce(sum(v), 0)::bigint as total from p left join l on p.parcel_id = l.parcel_id group by 1""",
    "tagged_detections": """with v as (select unnest(violations) as v from (select distinct summary_id, violations from results_summary))
select 'aerial' as source, coalesce(v.confidence, 'LOW') as confidence, coalesce(v.zone, 'Zone_2') as zone, count(*) as n from v group by 2, 3""",
    "summary_worst": """with r as (select parcel_id, score, upper(trim(risk_label)) as l from results_summary where upper(trim(risk_label)) in ('NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL')),
k as (select *, case l when 'NONE' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 else 4 end as o from r)
select parcel_id, arg_max(l, o) as worst_label, max(score)::bigint as best_score from k group by 1""",
    "surrogate_images": """select tile_path, row_number() over (order by tile_path) as image_id
from (select distinct tile_path from tile_results where tile_path is not null)""",
    "label_batches": """with i as (select row_number() over (order by tile_path) as image_id from (select distinct tile_path from tile_results where tile_path is not null))
select (image_id - 1) // 500 as batch_no, count(*) as n, min(image_id) as first_id from i group by 1""",
    "status_checklist": " union all ".join(
        f"select '{n}' as item, count(*) as n_rows, count(*) > 0 as present from {n}"
        for n in ("lab_taxonomy", "parcel_meta", "tile_results", "vlm_inference_results", "results_summary", "documents")
    ),
}

QUERIES = {
    f.__name__: f
    for f in (
        chip_findings, chip_parcels, chip_zones, chip_top5, class_scores_wide, detected_and_found, violation_counts, any_critical,
        tile_grid_pad, tile_grid_snap, tile_grid_drop, zone_by_box, zone_by_distance, manifest_rescale, resume_pending,
        default_offsets, summary_worst, breakdown_merged, tagged_detections, surrogate_images, label_batches, status_checklist,
    )
}

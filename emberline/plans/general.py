"""Queries over orders, events, embeddings and other plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import boxes, score, vectors
from emberline.operators import joins, raster, report, sample, suppress
from emberline.plans.detections import greedy_sql
from emberline.plans.tables import table
from emberline.sources import writers

ORDER = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as detections: returned ones are violations, zones by quantity, severities by discount."""
    li = _t(spark, sf, "lineitem")
    zone = F.when(F.col("l_quantity") <= 5, "Zone_0").when(F.col("l_quantity") <= 30, "Zone_1").otherwise("Zone_2")
    sev = F.when(F.col("l_discount") >= 0.08, "CRITICAL").when(F.col("l_discount") >= 0.05, "HIGH").when(F.col("l_discount") >= 0.02, "MEDIUM").otherwise("LOW")
    rows = li.select(
        "l_orderkey", zone.alias("zone"), sev.alias("severity"), F.when(F.col("l_returnflag") == "R", "VIOLATION").otherwise("COMPLIANT").alias("status"),
        F.col("l_linestatus").alias("klass"),
    )
    return score.zone_score(rows, "l_orderkey", "status", "zone", "severity", "klass")


def order_top(spark: SparkSession, sf: str) -> DataFrame:
    return order_scores(spark, sf).orderBy(F.desc("score"), "l_orderkey").limit(10)


def order_worst(spark: SparkSession, sf: str) -> DataFrame:
    rank = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(score.worst("o_orderpriority", rank).alias("worst_priority"), F.count("*").alias("n"))


def order_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return report.pivot_counts(_t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ("O", "F", "P"))


def stretch_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event values stretched between the 2nd and 98th percentile of their type, counted per tenth of the scale."""
    s = raster.stretch(_t(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", nodata=3.4e38)
    return s.groupBy("event_type", F.floor(F.col("scaled") / 26).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum("scaled").alias("total"))


def percentile_events(spark: SparkSession, sf: str) -> DataFrame:
    p = raster.percentile_bounds(_t(spark, sf, "events"), ["event_type"], "value")
    return p.select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def user_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Users as tiles: statistics of their values, those with too large a share of low values left out."""
    e = _t(spark, sf, "events").withColumn("v", F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")))
    kept = raster.not_blank(raster.tile_stats(e, ["user_id"], "v", nodata=450.0), zero_limit=0.35, missing_limit=0.2)
    return kept.select("user_id", "n", "n_valid", F.round("mean", 4).alias("mean"), "greatest", F.round("zero_share", 6).alias("zero_share"))


def stratified_k(spark: SparkSession, sf: str) -> DataFrame:
    return sample.k_per_stratum(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", 2).select("c_custkey", "c_nationkey", "c_mktsegment")


def padded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.padded_sample(_t(spark, sf, "customer"), ["c_nationkey"], "c_custkey", 3, 120).select("c_custkey")


def fraction_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.exact_fraction(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


def _prototypes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").filter("vec_id < 24").select((F.col("vec_id") % 8).alias("class"), vectors.unit(F.col("embedding")).alias("prompt"))


def class_maxpool(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest cosine per class over its three prompts, at least 0.1."""
    s = vectors.prompt_scores(_t(spark, sf, "embeddings").withColumn("u", vectors.unit(F.col("embedding"))), "vec_id", "u", _prototypes(spark, sf), "class", "prompt")
    return s.select("vec_id", F.col("class").cast("long").alias("class"), F.round("score", 4).alias("score")).filter("score >= 0.1")


def cosine_top5(spark: SparkSession, sf: str) -> DataFrame:
    s = vectors.prompt_scores(_t(spark, sf, "embeddings").withColumn("u", vectors.unit(F.col("embedding"))), "vec_id", "u", _prototypes(spark, sf), "class", "prompt")
    named = s.select("vec_id", F.col("class").cast("string").alias("class"), F.round("score", 3).alias("score"))
    return vectors.top_string(named, "vec_id", 5)


def softmax_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors kept by a two-way softmax of their first two coordinates; label 0 is always kept."""
    e = _t(spark, sf, "embeddings")
    p = vectors.two_way_softmax(10 * F.get("embedding", F.lit(0)).cast("double"), 10 * F.get("embedding", F.lit(1)).cast("double"))
    return e.withColumn("p", F.round(p, 6)).filter("label = 0 or p >= 0.7 or p is null").select("vec_id", F.col("label").cast("long").alias("label"), "p")


def order_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression among boxes made from order lines, within order and status."""
    b = F.array(F.col("l_quantity") * 4, F.col("l_tax") * 400, F.col("l_quantity") * 4 + 60, F.col("l_tax") * 400 + 40)
    rows = _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linestatus", b.alias("box"), (-F.col("l_extendedprice")).alias("rank"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
    )
    kept = suppress.suppress(rows, ["l_orderkey", "l_linestatus"], "box", ["rank", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_kept"))


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Nation keys of customers and suppliers: in either, in both, in the first only."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = _t(spark, sf, "supplier").filter("s_acctbal > 3000").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("op"), F.col("k").cast("long").alias("k"))
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "both")).unionByName(tag(c.join(s, "k", "left_anti"), "first_only"))


def sorted_report(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked lines of the priority and status counts."""
    n = _t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    lines = report.text_lines(n, (("o_orderpriority", 16), ("o_orderstatus", 2), ("n", -8)), (rank, -F.col("n"), "o_orderpriority"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return report.markdown(n, ("o_orderpriority", "n"), ("o_orderpriority",)).withColumn("line_no", F.col("line_no").cast("long"))


def coco_nest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents of images and boxes, nested and counted again."""
    o = _t(spark, sf, "orders").select((F.col("o_custkey")).alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("file_name"))
    li = _t(spark, sf, "lineitem").join(o.select("doc", F.col("id").alias("l_orderkey")), "l_orderkey")
    box = boxes.to_xywh(F.array(F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") + 10, F.lit(5.0)))
    ann = li.select("doc", F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_partkey", "l_suppkey", box.alias("bbox"), (F.get(box, F.lit(2)) * F.get(box, F.lit(3))).alias("area"))
    cats = _t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nested = writers.coco(o, ann, cats, "id", "image_id")
    return nested.groupBy(F.col("doc").alias("o_custkey")).agg(
        F.sum(F.size("images")).cast("long").alias("n_images"), F.sum(F.greatest(F.size("annotations"), F.lit(0))).cast("long").alias("n_boxes"),
        F.coalesce(F.sum(F.aggregate("annotations", F.lit(0.0), lambda acc, x: acc + x["area"])), F.lit(0.0)).alias("area"),
        F.max(F.size("categories")).cast("long").alias("n_categories"),
    )


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per cell of a 4 x 4 grid with closed edges."""
    p = _t(spark, sf, "customer").select(F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 500) % 10000).cast("double").alias("y"))
    return joins.snapped_cells(p, "x", "y", 2500.0, 4, 4).groupBy("cell").agg(F.count("*").alias("n"))


_PROTO = """
u as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
p as (select vec_id % 8 as class, e as prompt from u where vec_id < 24),
s as (select u.vec_id, p.class, max(list_cosine_similarity(u.e, p.prompt)) as score from u cross join p group by 1, 2)
"""
_LINE = """
with l as (select l_orderkey, l_linestatus, l_returnflag = 'R' as hit,
  case when l_quantity <= 5 then 3 when l_quantity <= 30 then 2 else 1 end * case when l_discount >= 0.08 then 3 when l_discount >= 0.05 then 2 when l_discount >= 0.02 then 1 else 0 end as w from lineitem),
s as (select l_orderkey, coalesce(sum(w) filter (hit), 0)::bigint as score, count(*) filter (hit) as violation_count, count(distinct l_linestatus) filter (hit) as n_classes from l group by 1)
select *, case when score <= 0 then 'LOW' when score <= 4 then 'MEDIUM' when score <= 9 then 'HIGH' else 'CRITICAL' end as risk_label from s
"""

SQL = {
    "order_scores": _LINE,
    "order_top": _LINE + " order by score desc, l_orderkey limit 10",
    "order_worst": "select o_custkey, min(o_orderpriority) as worst_priority, count(*) as n from orders group by 1",
    "order_crosstab": """select o_orderpriority, count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'F') as "F",
  count(*) filter (o_orderstatus = 'P') as "P", count(*) as total from orders group by 1""",
    "order_nms": f"""with recursive placed as (
  select l_orderkey, l_linestatus, [l_quantity * 4, l_tax * 400, l_quantity * 4 + 60, l_tax * 400 + 40]::double[] as box, -l_extendedprice as rank, l_partkey, l_suppkey, l_linenumber, l_shipdate from lineitem),
{greedy_sql("placed", "l_orderkey, l_linestatus", "rank, l_partkey, l_suppkey, l_linenumber, l_shipdate", "l_orderkey")}
select l_orderkey, count(*) as n_kept from kept group by 1""",
    "stretch_events": """with b as (select event_type, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from events group by 1),
s as (select e.event_type, trunc(greatest(0, least(255, (value - lo) / (hi - lo) * 255))) as sc from events e join b on e.event_type = b.event_type)
select event_type, floor(sc / 26)::bigint as bin, count(*) as n, sum(sc)::bigint as total from s group by 1, 2""",
    "percentile_events": "select event_type, round(quantile_cont(value, 0.02), 6) as lo, round(quantile_cont(value, 0.98), 6) as hi from events group by 1",
    "user_tiles": """with v as (select user_id, case when value < 20 then 0 else value end as v from events),
s as (select user_id, count(*) as n, count(*) filter (v <= 450) as n_valid, avg(v) filter (v <= 450) as mean, max(v) filter (v <= 450) as greatest,
  avg((v = 0)::int::double) as zero_share, avg((not coalesce(v <= 450, false))::int::double) as miss from v group by 1)
select user_id, n, n_valid, round(mean, 4) as mean, greatest, round(zero_share, 6) as zero_share from s where zero_share <= 0.35 and miss <= 0.2""",
    "stratified_k": """select c_custkey, c_nationkey, c_mktsegment from customer
qualify row_number() over (partition by c_nationkey, c_mktsegment order by md5(c_custkey || '|42'), c_custkey) <= 2""",
    "padded_sample": """with r as (select c_custkey, md5(c_custkey || '|42') as h, row_number() over (partition by c_nationkey order by md5(c_custkey || '|42'), c_custkey) > 3 as late from customer)
select c_custkey from r order by late, h, c_custkey limit 120""",
    "fraction_sample": """select o_orderkey from orders qualify row_number() over (order by md5(o_orderkey || '|42'), o_orderkey) <= greatest(1, floor(count(*) over () * 0.2))""",
    "class_maxpool": f"with {_PROTO} select * from (select vec_id, class, round(score, 4) as score from s) where score >= 0.1",
    "cosine_top5": f"""with {_PROTO}, q as (select vec_id, class::varchar as class, round(score, 3) as score from s),
r as (select *, row_number() over (partition by vec_id order by score desc, class) as rn from q)
select vec_id, string_agg(class || '=' || printf('%.3f', score), ', ' order by rn) as top from r where rn <= 5 group by 1""",
    "softmax_filter": """with e as (select vec_id, label, round(1 / (1 + exp(10 * embedding[1]::double - 10 * embedding[2]::double)), 6) as p from embeddings)
select vec_id, label::bigint as label, p from e where label = 0 or p >= 0.7 or p is null""",
    "set_ops": """with c as (select distinct c_nationkey as k from customer), s as (select distinct s_nationkey as k from supplier where s_acctbal > 3000)
select 'union' as op, k::bigint as k from (select k from c union select k from s) union all select 'both', k from (select k from c intersect select k from s)
union all select 'first_only', k from (select k from c except select k from s)""",
    "sorted_report": """with n as (select o_orderpriority as p, o_orderstatus as s, count(*) as n from orders group by 1, 2)
select row_number() over (order by case s when 'F' then 0 when 'O' then 1 else 2 end, n desc, p) as line_no,
  rpad(p, 16, ' ') || ' ' || rpad(s, 2, ' ') || ' ' || lpad(n::varchar, 8, ' ') as line from n""",
    "markdown_report": """with n as (select o_orderpriority as p, count(*) as n from orders group by 1)
select -1 as line_no, '| o_orderpriority | n |' as line union all select 0, '|---|---|'
union all select row_number() over (order by p), '| ' || p || ' | ' || n || ' |' from n""",
    "coco_nest": """with b as (select o_custkey, count(*) as n, sum(50.0) as a from lineitem join orders on l_orderkey = o_orderkey group by 1)
select o.o_custkey, count(*) as n_images, coalesce(max(b.n), 0) as n_boxes, coalesce(max(b.a), 0)::double as area, (select count(*) from region) as n_categories
from orders o left join b on o.o_custkey = b.o_custkey group by 1""",
    "grid_cells": """with p as (select c_acctbal as x, ((c_custkey * 500) % 10000)::double as y from customer), c as (select i * 4 + j as cell, i * 2500.0 as x0, j * 2500.0 as y0 from range(4) a(i), range(4) b(j))
select cell, count(*) as n from p join c on x between x0 and x0 + 2500 and y between y0 and y0 + 2500 group by 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        order_scores, order_top, order_worst, order_crosstab, stretch_events, percentile_events, user_tiles, stratified_k, padded_sample,
        fraction_sample, class_maxpool, cosine_top5, softmax_filter, order_nms, set_ops, sorted_report, markdown_report, coco_nest, grid_cells,
    )
}

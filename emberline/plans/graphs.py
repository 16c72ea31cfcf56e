"""Queries over the property graph of classes, zones and violations, built from the taxonomy and the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import graph, joins
from emberline.plans.chips import _CHIP, chips, findings
from emberline.plans.tables import table
from emberline.plans.texts import _SCOPE, _SQ, ABOVE, CATEGORIES, GROUND, KINDS, SCOPES, _any
from emberline.plans.texts import SEVERITY as ZONE_SEVERITY

SEVERITY = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    """object_class, violation_id, severity: every violation found for a class, once per occurrence."""
    f = chips(spark, sf, "compliance_findings").select(F.explode("compliance_findings").alias("f")).select(
        F.lower(F.trim("f.object_class")).alias("object_class"), F.explode("f.violations").alias("v")
    )
    return f.filter("v is not null and v.violation_id is not null and object_class is not null").select(
        "object_class", F.col("v.violation_id").alias("violation_id"), F.coalesce("v.severity", F.lit("LOW")).alias("severity")
    )


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    tax = table(spark, sf, "lab_taxonomy")
    objects = tax.select(F.col("object_class").alias("id"), F.lit("object").alias("type"), F.lit(None).cast("string").alias("severity"))
    zones = tax.select(F.explode(F.array(*map(F.lit, graph.ZONES))).alias("id"), F.lit("zone").alias("type"), F.lit(None).cast("string").alias("severity")).distinct()
    v = _violations(spark, sf)
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    worst = v.groupBy(F.col("violation_id").alias("id")).agg(
        F.lit("violation").alias("type"), F.max_by("severity", F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(0))).alias("severity")
    )
    return objects.unionByName(zones).unionByName(worst)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    tax = table(spark, sf, "lab_taxonomy")
    located = graph.expand_scope(tax.select("object_class", "typical_zone"), "typical_zone")
    found = located.select(F.col("object_class").alias("src"), F.col("typical_zone").alias("dst"), F.lit("typically_found_in").alias("relation"), F.lit(1.0).alias("confidence"))
    v = _violations(spark, sf).groupBy("object_class", "violation_id").agg(F.count("*").alias("n"))
    total = v.groupBy("object_class").agg(F.sum("n").alias("t"))
    cause = v.join(total, "object_class").select(
        F.col("object_class").alias("src"), F.col("violation_id").alias("dst"), F.lit("can_cause").alias("relation"),
        F.round(F.col("n") / F.col("t"), 4).alias("confidence"),
    )
    return found.unionByName(cause)


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose both ends exist."""
    return graph.both_ends_exist(_edges(spark, sf), _nodes(spark, sf))


def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(_edges(spark, sf))


def graph_top_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(_edges(spark, sf)).orderBy(F.desc("degree"), "id").limit(10)


def graph_in_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_degree(_edges(spark, sf), "typically_found_in")


def graph_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Classes without a violation that makes up most of what is found for them."""
    strong = _edges(spark, sf).filter("confidence >= 0.55 or relation <> 'can_cause'")
    nodes = _nodes(spark, sf).filter("type = 'object'")
    return graph.without_edge(nodes, strong, ["can_cause"]).select("id")


def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    hop = graph.neighbours(_edges(spark, sf), _nodes(spark, sf), node_type="violation")
    return hop.select("src", "dst", "dst_severity", "confidence")


def graph_induced(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among objects of outer zones, zones and violations that can be critical."""
    keep = _nodes(spark, sf).filter("type = 'zone' or (type = 'violation' and severity = 'CRITICAL') or id < 'm'").select("id")
    return graph.induced(_edges(spark, sf), keep).select("src", "dst", "relation")


def graph_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    return graph.two_hops(_edges(spark, sf).select("src", "dst"), F.col("id") == "raised_deck").withColumn("hops", F.col("hops").cast("long"))


def graph_best_edge(spark: SparkSession, sf: str) -> DataFrame:
    causes = _edges(spark, sf).filter("relation = 'can_cause'")
    return graph.best_edge(causes).select("src", "dst", "confidence")


def graph_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = findings(spark, sf).select(F.col("object_class").alias("canonical"), "zone").filter("canonical is not null")
    out = graph.lookup(asked, _edges(spark, sf), _nodes(spark, sf), SEVERITY)
    return out.select("canonical", "zone", "n_violations", "severity", F.col("severity_score").cast("long").alias("severity_score"))


def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context of three classes per zone."""
    asked = findings(spark, sf).select(F.col("object_class").alias("canonical"), "zone").filter("canonical is not null and zone is not null")
    found = graph.lookup(asked, _edges(spark, sf), _nodes(spark, sf), SEVERITY)
    return graph.combined_context(found, ("raised_deck", "refuse_cart", "motorhome"))


def graph_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Last severity per (class, violation): the earlier half of the chips is the graph, the later half writes over it."""
    f = chips(spark, sf, "compliance_findings").select("chip_id", F.explode("compliance_findings").alias("f")).select(
        "chip_id", F.lower(F.trim("f.object_class")).alias("src"), F.explode("f.violations").alias("v")
    )
    rows = f.filter("v is not null and v.violation_id is not null and src is not null").select(
        "chip_id", "src", F.col("v.violation_id").alias("dst"), F.coalesce("v.severity", F.lit("")).alias("severity"), F.concat_ws("|", F.lpad(F.col("chip_id").cast("string"), 12, "0"), F.coalesce("v.severity", F.lit(""))).alias("seq")
    )
    middle = F.lit(chips(spark, sf).agg(F.expr("(min(chip_id) + max(chip_id)) div 2")).first()[0])
    # a row that is there already has no place among the changes: were it compared with theirs, "~" would win
    stored = rows.filter(F.col("chip_id") <= middle).groupBy("src", "dst").agg(F.max_by("severity", "seq").alias("severity")).withColumn("seq", F.lit("~"))
    later = rows.filter(F.col("chip_id") > middle).drop("chip_id")
    return graph.upsert(stored, later, ["src", "dst"], "seq").select("src", "dst", "severity")


def graph_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Curated edges to every zone, added where the taxonomy has none."""
    tax = table(spark, sf, "lab_taxonomy").select(F.col("object_class").alias("src"))
    all_zones = tax.select("src", F.explode(F.array(*map(F.lit, graph.ZONES))).alias("dst"), F.lit("curated").alias("relation"), F.lit(0.4).alias("confidence"))
    base = _edges(spark, sf).filter("relation = 'typically_found_in'")
    return graph.insert_absent(base, all_zones, ["src", "dst"])


def capped_cross(spark: SparkSession, sf: str) -> DataFrame:
    """First two violations and first two zones of each class."""
    e = _edges(spark, sf)
    left = e.filter("relation = 'can_cause'").select(F.col("src").alias("object_class"), F.col("dst").alias("violation"))
    right = e.filter("relation = 'typically_found_in'").select(F.col("src").alias("object_class"), F.col("dst").alias("zone"))
    return joins.capped_cross(left, right, "object_class", "violation", "zone", 2)


# Sources of documents that stand for the rule texts: the statute, the standard, and the guide that is taken in later, with their relations.
RULE_SOURCES = {"statute_digest": "governed_by", "training_sheets": "subject_to", "insurer_memos": "advised_by"}


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """rule_id, source, relation, scope, kind, aerial, severity, text of every rule document."""
    d = table(spark, sf, "documents").filter(F.col("source").isin(*RULE_SOURCES))
    scope = text.first_pattern(F.col("text"), SCOPES, "ALL")
    return d.select(
        F.concat_ws("_", "source", "doc_id").alias("rule_id"), "source", text.mapped(F.col("source"), RULE_SOURCES, "").alias("relation"), scope.alias("scope"),
        text.first_category(F.col("text"), KINDS, "structural").alias("kind"), text.unless_vetoed(F.col("text"), ABOVE, GROUND).alias("aerial"),
        text.mapped(scope, ZONE_SEVERITY, "LOW").alias("severity"), text.squeeze(F.col("text"), 400).alias("text"), F.col("doc_id"), F.col("text").alias("full_text"),
    )


def _scored(spark: SparkSession, sf: str, rules: DataFrame) -> DataFrame:
    """Edges of classes to rules above the floor."""
    objects = table(spark, sf, "lab_taxonomy").select("object_class", "aliases")
    found = graph.scored_edges(objects, rules.select("rule_id", F.col("full_text").alias("text")), "", CATEGORIES, least=0.6).drop("relation")
    return found.join(rules.select(F.col("rule_id").alias("dst"), "relation"), "dst").select("src", "dst", "relation", "confidence")


def full_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes of the graph: classes, zones, violations, and the rules of all sources with their derived attributes."""
    rest = _nodes(spark, sf).select("id", "type", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("aerial"), "severity")
    return rest.unionByName(_rules(spark, sf).select(F.col("rule_id").alias("id"), F.lit("regulation").alias("type"), "scope", "kind", "aerial", "severity"))


def full_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All edges of the graph: where classes lie, what they cause, zones to the rules that cover them, classes to rules above the floor."""
    rules = _rules(spark, sf)
    covered = graph.expand_scope(rules.select("rule_id", "scope"), "scope").select(F.col("scope").alias("src"), F.col("rule_id").alias("dst"), F.lit("covered_by").alias("relation"), F.lit(1.0).alias("confidence"))
    return _edges(spark, sf).unionByName(covered).unionByName(_scored(spark, sf, rules))


def graph_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A further source taken into the graph of the others: its rules are new nodes, its edges written over those that are there, dangling ones left out.

    The later source also repeats the classes with a confidence raised by a tenth for every rule of the statute that it names by number; result per relation and confidence.
    """
    rules = _rules(spark, sf)
    first, later = rules.filter("source <> 'insurer_memos'"), rules.filter("source = 'insurer_memos' or doc_id % 3 = 0")
    node = lambda df: df.select(F.col("rule_id").alias("id"), "scope")
    nodes = graph.insert_absent(node(first), node(later), ["id"])
    base = _scored(spark, sf, first).withColumn("seq", F.lit("0"))
    more = _scored(spark, sf, later).withColumn("confidence", F.least(F.col("confidence") + 0.1, F.lit(1.0))).withColumn("seq", F.lit("1"))
    merged = graph.upsert(base, more, ["src", "dst"], "seq").drop("seq")
    ids = nodes.select("id").unionByName(table(spark, sf, "lab_taxonomy").select(F.col("object_class").alias("id")))
    return graph.both_ends_exist(merged, ids).groupBy("relation", F.round("confidence", 2).alias("confidence")).agg(F.count("*").alias("n"))


def graph_zone_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rules and violations of each class found in a zone; a rule counts if its scope is that zone or ALL."""
    asked = findings(spark, sf).select(F.col("object_class").alias("canonical"), "zone").filter("canonical is not null and zone is not null")
    rules = _rules(spark, sf)
    causes = graph.neighbours(_edges(spark, sf).filter("relation = 'can_cause'"), _nodes(spark, sf)).withColumnRenamed("dst_severity", "severity")
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    causes = causes.select("src", "dst", "severity", F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(1)).alias("severity_rank"))
    return graph.zone_lookup(asked, rules, _scored(spark, sf, rules), causes)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 7919) % 9973).cast("double").alias("y")
    )


def band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return joins.band_pairs(_points(spark, sf), "id", "x", "y", 150.0)


def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clusters(_points(spark, sf), "id", "x", "y", 150.0)


def cluster_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Extent, grown by 10 and clipped to the area, centre and size of each cluster."""
    p = _points(spark, sf)
    c = graph.clusters(p, "id", "x", "y", 150.0).join(p, "id")
    return c.groupBy("component").agg(
        F.count("*").alias("n"), F.greatest(F.min("x") - 10, F.lit(-999.0)).alias("x0"), F.least(F.max("x") + 10, F.lit(9999.0)).alias("x1"),
        F.greatest(F.min("y") - 10, F.lit(0.0)).alias("y0"), F.least(F.max("y") + 10, F.lit(9973.0)).alias("y1"), F.round(F.avg("y"), 4).alias("cy"),
    )


_GRAPH = f"""{_CHIP},
viol0 as (select lower(trim(f.object_class)) as object_class, unnest(f.violations) as v, chip_id from f0 where f is not null),
viol as (select object_class, v.violation_id as violation_id, coalesce(v.severity, 'LOW') as severity, v.severity as raw_severity, chip_id from viol0
  where v is not null and v.violation_id is not null and object_class is not null),
rk as (select * from (values ('NONE', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) t(s, r)),
node as (
  select object_class as id, 'object' as type, null::varchar as severity from lab_taxonomy
  union all select * from (values ('Zone_0', 'zone', null), ('Zone_1', 'zone', null), ('Zone_2', 'zone', null)) z
  union all select violation_id, 'violation', arg_max(severity, coalesce(r, 0)) from viol left join rk on severity = s group by 1),
located as (
  select object_class, unnest(case when coalesce(typical_zone, 'ALL') = 'ALL' then ['Zone_0', 'Zone_1', 'Zone_2'] else [typical_zone] end) as z from lab_taxonomy),
vc as (select object_class, violation_id, count(*) as n from viol group by 1, 2),
edge as (
  select object_class as src, z as dst, 'typically_found_in' as relation, 1.0::double as confidence from located
  union all select object_class, violation_id, 'can_cause', round(n::double / sum(n) over (partition by object_class), 4) from vc)
"""
_PTS = "pts as (select c_custkey as id, c_acctbal as x, ((c_custkey * 7919) % 9973)::double as y from customer)"
_PAIRS = f"""{_PTS}, pairs as (
  select a.id as id_a, b.id as id_b from pts a join pts b on a.id < b.id and abs(a.x - b.x) <= 150
    and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500)"""
_COMP = f"""with recursive {_PAIRS}, both_ as (select id_a as s, id_b as d from pairs union all select id_b, id_a from pairs),
reach as (select id, id as r from pts union select both_.d, reach.r from reach join both_ on reach.id = both_.s),
comp as (select id, min(r) as component from reach group by 1)"""

_RULES = f"""
rule as (
  select source || '_' || doc_id as rule_id, source, doc_id, text as full_text, case source when 'statute_digest' then 'governed_by' when 'training_sheets' then 'subject_to' else 'advised_by' end as relation,
    {_SCOPE} as scope, case {" ".join(f"when {_any(w)} then '{k}'" for k, w in KINDS)} else 'structural' end as kind, {_any(ABOVE)} and not {_any(GROUND)} as aerial, {_SQ} as words
  from documents where source in ('statute_digest', 'training_sheets', 'insurer_memos')),
sev as (select *, case scope when 'Zone_0' then 'CRITICAL' when 'Zone_1' then 'HIGH' when 'Zone_2' then 'MEDIUM' else 'LOW' end as severity from rule),
scoped as (select *, unnest(case when scope = 'ALL' then ['Zone_0', 'Zone_1', 'Zone_2'] else [scope] end) as z from sev),
score as (
  select object_class as src, rule_id as dst, relation, source, doc_id, case when contains(lower(full_text), replace(lower(object_class), '_', ' ')) then 1.0
    when len(list_filter(aliases, lambda a: contains(lower(rule.full_text), lower(a)))) > 0 then 0.8
    when {_any(CATEGORIES, "lower(full_text)")} then 0.6 else 0.4 end::double as confidence from rule cross join lab_taxonomy),
above as (select * from score where confidence >= 0.6)
"""

SQL = {
    "full_graph_nodes": f"""with {_GRAPH}, {_RULES} select id, type, null::varchar as scope, null::varchar as kind, null::boolean as aerial, severity from node
union all select rule_id, 'regulation', scope, kind, aerial, severity from sev""",
    "full_graph_edges": f"""with {_GRAPH}, {_RULES} select src, dst, relation, confidence from edge union all select z, rule_id, 'covered_by', 1.0::double from scoped
union all select src, dst, relation, confidence from above""",
    "graph_ingest": f"""with {_RULES}, m as (
  select src, dst, relation, case when source = 'insurer_memos' or doc_id % 3 = 0 then least(confidence + 0.1, 1.0) else confidence end as c from above)
select relation, round(c, 2) as confidence, count(*) as n from m group by 1, 2""",
    "graph_zone_lookup": f"""with {_GRAPH}, {_RULES}, asked as (select distinct object_class as canonical, zone from finding where object_class is not null and zone is not null),
per as (select a.canonical, a.zone, s.rule_id, s.words, coalesce(e.confidence, 0.4) as c from asked a left join scoped s on a.zone = s.z left join above e on e.src = a.canonical and e.dst = s.rule_id),
agg as (select canonical, zone, count(rule_id) as n_rules, count(*) filter (c >= 0.6) as n_direct, arg_min(rule_id, (-c, rule_id)) as best_rule,
  case when count(rule_id) > 0 then max(c) end as best_confidence, arg_min(substr(words, 1, 150), (-c, rule_id)) as best_text from per group by 1, 2),
v as (select src, count(*) as n, arg_max(severity, coalesce(r, 1)) as severity from edge join node on dst = id left join rk on severity = s where relation = 'can_cause' group by 1)
select canonical, zone, n_rules, n_direct, best_rule, best_confidence, best_text, coalesce(v.n, 0) as n_violations, coalesce(v.severity, 'UNKNOWN') as severity from agg left join v on canonical = src""",
    "graph_edges": f"with {_GRAPH} select * from edge where src in (select id from node) and dst in (select id from node)",
    "graph_degree": f"with {_GRAPH} select id, count(*) as degree from (select src as id from edge union all select dst from edge) group by 1",
    "graph_top_degree": f"with {_GRAPH} select id, count(*) as degree from (select src as id from edge union all select dst from edge) group by 1 order by 2 desc, 1 limit 10",
    "graph_in_edges": f"with {_GRAPH} select dst as id, count(*) as n_in from edge where relation = 'typically_found_in' group by 1",
    "graph_gaps": f"with {_GRAPH} select id from node where type = 'object' and id not in (select src from edge where relation = 'can_cause' and confidence >= 0.55)",
    "graph_neighbours": f"with {_GRAPH} select src, dst, severity as dst_severity, confidence from edge join node on dst = id where type = 'violation'",
    "graph_induced": f"""with {_GRAPH}, keep as (select id from node where type = 'zone' or (type = 'violation' and severity = 'CRITICAL') or id < 'm')
select src, dst, relation from edge where src in (select id from keep) and dst in (select id from keep)""",
    "graph_two_hops": f"""with {_GRAPH}, both_ as (select src, dst from edge union select dst, src from edge), z as (select 'raised_deck' as id, 0 as hops),
o as (select dst as id, 1 as hops from both_ where src = 'raised_deck'), t as (select b.dst as id, 2 as hops from o join both_ b on b.src = o.id)
select id, min(hops)::bigint as hops from (select * from z union all select * from o union all select * from t) group by 1""",
    "graph_best_edge": f"""with {_GRAPH} select src, dst, confidence from edge where relation = 'can_cause'
qualify row_number() over (partition by src order by confidence desc, dst) = 1""",
    "graph_lookup": f"""with {_GRAPH}, asked as (select distinct object_class as canonical, zone from finding where object_class is not null),
hop as (select src, count(*) filter (type = 'violation') as nv, max(case when type = 'violation' then coalesce(r, 1) end) as sc
  from edge join node on dst = id left join rk on severity = s group by 1)
select canonical, zone, coalesce(nv, 0) as n_violations,
  case coalesce(sc, 0) when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as severity,
  coalesce(sc, 0)::bigint as severity_score from asked left join hop on canonical = src""",
    "graph_context": f"""with {_GRAPH}, z as (select distinct zone, object_class as c from finding where object_class in ('raised_deck', 'refuse_cart', 'motorhome') and zone is not null),
l as (select src, string_agg(distinct type || ': ' || dst, chr(10) order by type || ': ' || dst) as t from edge join node on dst = id where type = 'violation' group by 1),
o as (select zone, c, list_position(['raised_deck', 'refuse_cart', 'motorhome'], c) as i, upper(replace(c, '_', ' ')) || chr(10) || coalesce(t, '') as t from z left join l on src = c)
select zone, string_agg(t, chr(10) || chr(10) order by i) as context from o group by 1""",
    "graph_upsert": f"""with {_GRAPH} select object_class as src, violation_id as dst,
  arg_max(coalesce(raw_severity, ''), (chip_id, coalesce(raw_severity, ''))) as severity from viol group by 1, 2""",
    "graph_insert_absent": f"""with {_GRAPH}, base as (select * from edge where relation = 'typically_found_in'),
more as (select object_class as src, unnest(['Zone_0', 'Zone_1', 'Zone_2']) as dst, 'curated' as relation, 0.4::double as confidence from lab_taxonomy)
select * from base union all select * from more m where not exists (select 1 from base b where b.src = m.src and b.dst = m.dst)""",
    "capped_cross": f"""with {_GRAPH}, l as (select src, dst from edge where relation = 'can_cause' qualify row_number() over (partition by src order by dst) <= 2),
r as (select src, dst from edge where relation = 'typically_found_in' qualify row_number() over (partition by src order by dst) <= 2)
select coalesce(l.src, r.src) as object_class, coalesce(l.dst, '—') as violation, coalesce(r.dst, '—') as zone from l full join r on l.src = r.src""",
    "band_pairs": f"with {_PAIRS} select * from pairs",
    "components": _COMP + " select * from comp",
    "cluster_extent": _COMP + """ select component, count(*) as n, greatest(min(x) - 10, -999.0) as x0, least(max(x) + 10, 9999.0) as x1,
  greatest(min(y) - 10, 0.0) as y0, least(max(y) + 10, 9973.0) as y1, round(avg(y), 4) as cy from comp join pts using (id) group by 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_degree, graph_top_degree, graph_in_edges, graph_gaps, graph_neighbours, graph_induced, graph_two_hops,
        graph_best_edge, graph_lookup, graph_context, graph_upsert, graph_insert_absent, full_graph_nodes, full_graph_edges,
        graph_ingest, graph_zone_lookup, capped_cross, band_pairs, components, cluster_extent,
    )
}

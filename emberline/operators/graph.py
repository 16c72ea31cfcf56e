"""Property graphs as two DataFrames: nodes(id, type, ...) and edges(src, dst, relation, ...)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from emberline.functions.text import contains_any
from emberline.session import cut

ZONES = ("Zone_0", "Zone_1", "Zone_2")
MAX_OBJECTS = 2000


def expand_scope(rows: DataFrame, column: str, everything: str = "ALL", values: Sequence[str] = ZONES) -> DataFrame:
    """Rows whose scope is `everything` (or NULL) once per value, the others unchanged."""
    whole = F.coalesce(F.col(column), F.lit(everything)) == everything
    return rows.withColumn(column, F.explode(F.when(whole, F.array(*map(F.lit, values))).otherwise(F.array(F.col(column)))))


def scored_edges(
    objects: DataFrame, rules: DataFrame, relation: str, categories: Sequence[str], floor: float = 0.4, least: float = 0.4
) -> DataFrame:
    """src, dst, relation, confidence for every object and rule text whose graded match reaches `least`.

    objects: object_class, aliases, a taxonomy of at most MAX_OBJECTS rows (checked), which is laid beside each text as
    a literal: the match is a substring test without an equality, so every rule is tested against every object inside
    its row, without a join. With the default floor all pairs are kept, as each object is governed by each rule to
    some degree.
    """
    taxonomy = objects.select("object_class", "aliases").limit(MAX_OBJECTS + 1).collect()
    if len(taxonomy) > MAX_OBJECTS:
        raise ValueError(f"more than {MAX_OBJECTS} objects")
    if not taxonomy:
        return rules.select(F.lit("").alias("src"), F.col("rule_id").alias("dst"), F.lit(relation).alias("relation"), F.lit(0.0).alias("confidence")).limit(0)
    # names and texts are lowered once, not for every pair
    listed = F.array(
        *[
            F.struct(
                F.lit(o["object_class"]).alias("src"), F.lit(o["object_class"].lower().replace("_", " ")).alias("name"),
                F.array(*[F.lit(x.lower()) for x in o["aliases"] or [] if x is not None]).cast("array<string>").alias("aliases"),
            )
            for o in taxonomy
            if o["object_class"] is not None
        ]
    )
    rest = F.when(contains_any(F.col("text"), categories), 0.6).otherwise(floor)
    rules = rules.select("rule_id", F.lower("text").alias("__low"), rest.alias("__rest"))
    low = F.col("__low")

    def confidence(o: Column) -> Column:
        alias = F.exists(o["aliases"], lambda a: F.contains(low, a))
        return F.when(F.contains(low, o["name"]), 1.0).when(F.coalesce(alias, F.lit(False)), 0.8).otherwise(F.col("__rest"))

    rated = F.when(F.col("__rest").isNotNull(), F.transform(listed, lambda o: F.struct(o["src"].alias("src"), confidence(o).alias("confidence"))))
    kept = F.filter(rated, lambda x: x["confidence"] >= least)
    out = rules.select("rule_id", F.explode(kept).alias("m"))
    return out.select(F.col("m.src").alias("src"), F.col("rule_id").alias("dst"), F.lit(relation).alias("relation"), F.col("m.confidence").alias("confidence"))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both with the last write per key: changes win over the base, and the greatest `order` among changes.

    Both have the same columns; rows with a NULL key part are kept as a key of their own.
    """
    rest = [c for c in base.columns if c not in keys]
    tagged = base.withColumn("__w", F.lit(0)).unionByName(changes.withColumn("__w", F.lit(1)))
    last = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__w", order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_absent(base: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base and those rows of `more` whose key it lacks."""
    return base.unionByName(more.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def both_ends_exist(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    return edges.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None, node_type: str | None = None) -> DataFrame:
    """One hop out: edges with the attributes of the target as columns dst_*; missing targets give NULLs."""
    chosen = edges if relation is None else edges.filter(F.col("relation") == relation)
    target = nodes.select(*[F.col(c).alias(f"dst_{c}") for c in nodes.columns])
    out = chosen.join(target, F.col("dst") == F.col("dst_id"), "left")
    return out if node_type is None else out.filter(F.col("dst_type") == node_type)


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: in plus out, a loop counting twice. One pass: each edge emits both ends, combined before the shuffle."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    return both_ends_exist(edges, ids)


def without_edge(nodes: DataFrame, edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Nodes that no edge of these relations leaves."""
    left = edges.filter(F.col("relation").isin(*relations)).select(F.col("src").alias("__s")).distinct()
    return nodes.join(left, F.col("id") == F.col("__s"), "left_anti")


def two_hops(edges: DataFrame, start: Column) -> DataFrame:
    """id, hops (0, 1 or 2): the neighbourhood of the nodes for which start(id) holds, edges taken both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    zero = both.select(F.col("src").alias("id")).filter(start).distinct()
    one = zero.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
    two = one.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
    tagged = zero.withColumn("hops", F.lit(0)).unionByName(one.withColumn("hops", F.lit(1))).unionByName(two.withColumn("hops", F.lit(2)))
    return tagged.groupBy("id").agg(F.min("hops").alias("hops"))


def resolve_alias(labels: DataFrame, label: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """labels with canonical: the name itself, then an equal alias, then containment either way, else the label.

    Names and aliases are tried in their order within each tier; containment also takes a name with blanks for
    underscores. A small literal vocabulary, tested inside the row without a join.
    """
    low = F.trim(F.lower(F.col(label)))
    tiers: list[tuple[Column, str]] = [(low == name, name) for name in aliases]
    tiers += [(low.isin(*words), name) for name, words in aliases.items() if words]
    for name, words in aliases.items():
        hit = F.contains(low, F.lit(name.replace("_", " ")))
        for w in words:
            hit = hit | F.contains(low, F.lit(w)) | F.contains(F.lit(w), low)
        tiers.append((hit & (low != ""), name))
    out: Column | None = None
    for hit, name in tiers:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return labels.withColumn("canonical", F.col(label) if out is None else out.otherwise(F.col(label)))


def lookup(requests: DataFrame, edges: DataFrame, nodes: DataFrame, severity_order: Mapping[str, int]) -> DataFrame:
    """For each (canonical, zone) asked: n_regulations, n_violations, severity (worst), severity_score, context text.

    Regulations are reached by any edge, violations likewise, regardless of the zone; unknown classes give zeros, NONE
    and an empty context. The asked pairs are distinct before the join.
    """
    asked = requests.select("canonical", "zone").distinct()
    hop = neighbours(edges, nodes)
    rank = F.create_map(*[F.lit(x) for kv in severity_order.items() for x in kv])
    reached = hop.groupBy(F.col("src").alias("canonical")).agg(
        F.count_if(F.col("dst_type") == "regulation").alias("n_regulations"),
        F.count_if(F.col("dst_type") == "violation").alias("n_violations"),
        F.max(F.when(F.col("dst_type") == "violation", F.coalesce(F.try_element_at(rank, F.col("dst_severity")), F.lit(1)))).alias("score"),
        F.array_sort(
            F.collect_set(F.when(F.col("dst_type").isin("regulation", "violation"), F.concat_ws(": ", "dst_type", "dst")))
        ).alias("lines"),
    )
    names = F.create_map(*[F.lit(x) for k, v in sorted(severity_order.items(), reverse=True) for x in (v, k)])
    out = asked.join(reached, "canonical", "left")
    score = F.coalesce("score", F.lit(0))
    return out.select(
        "canonical", "zone",
        F.coalesce("n_regulations", F.lit(0)).alias("n_regulations"),
        F.coalesce("n_violations", F.lit(0)).alias("n_violations"),
        F.when(score == 0, "NONE").otherwise(F.try_element_at(names, score)).alias("severity"),
        score.alias("severity_score"),
        F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n").alias("context"),
    )


def zone_lookup(asked: DataFrame, rules: DataFrame, edges: DataFrame, violations: DataFrame, floor: float = 0.4, most: int = 150) -> DataFrame:
    """canonical, zone, n_rules, n_direct, best_rule, best_confidence, best_text, n_violations, severity of each distinct pair asked.

    asked: canonical, zone. rules: rule_id, scope (a zone, or ALL or NULL for each), text. edges: src, dst, confidence, those above the floor; every class is
    governed by every other rule at the floor, so those are counted by zone and never formed. violations: src, dst, severity_rank, severity.
    Only rules whose scope is the zone asked or ALL count. best_rule is that of greatest confidence (ties: the least id), which is the least id in
    scope where no edge is above the floor; best_text are the first `most` characters of its text. A zone without a rule gives 0 and NULL.
    """
    asked = asked.select("canonical", "zone").distinct()
    scoped = expand_scope(rules.select("rule_id", F.col("scope").alias("zone")), "zone")
    by_zone = scoped.groupBy("zone").agg(F.count("*").alias("n_rules"), F.min("rule_id").alias("__least"))
    direct = edges.join(scoped, F.col("dst") == F.col("rule_id")).groupBy(F.col("src").alias("canonical"), "zone").agg(
        F.count("*").alias("n_direct"), F.max("confidence").alias("__top"), F.min_by("dst", F.struct(-F.col("confidence"), "dst")).alias("__best")
    )
    worst = violations.groupBy(F.col("src").alias("canonical")).agg(F.count("*").alias("n_violations"), F.max_by("severity", "severity_rank").alias("severity"))
    out = asked.join(by_zone, "zone", "left").join(direct, ["canonical", "zone"], "left").join(worst, "canonical", "left")
    out = out.select(
        "canonical", "zone", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"), F.coalesce("__best", "__least").alias("best_rule"),
        F.coalesce("__top", F.when(F.col("__least").isNotNull(), floor)).alias("best_confidence"), F.coalesce("n_violations", F.lit(0)).alias("n_violations"),
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
    )
    words = rules.select(F.col("rule_id").alias("best_rule"), F.substring("text", 1, most).alias("best_text"))
    return out.join(words, "best_rule", "left")


def combined_context(contexts: DataFrame, classes: Sequence[str], gap: str = "\n\n") -> DataFrame:
    """zone, context: the texts of a few classes joined, in the order given, per zone; missing ones are left out."""
    listed = F.array(*map(F.lit, classes))
    rows = contexts.filter(F.col("canonical").isin(*classes)).groupBy("zone").agg(
        F.array_sort(F.collect_list(F.struct(F.array_position(listed, F.col("canonical")).alias("i"), "canonical", "context"))).alias("l")
    )
    titled = F.transform("l", lambda x: F.concat(F.upper(F.replace(x["canonical"], F.lit("_"), F.lit(" "))), F.lit("\n"), x["context"]))
    return rows.select("zone", F.array_join(titled, gap).alias("context"))


def best_edge(edges: DataFrame, order: str = "dst") -> DataFrame:
    """Per source the edge of greatest confidence; ties go to the least `order`."""
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), order)
    return edges.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """v, u: each node and the least node of its component, of edges(v, u); least nodes have no row."""
    parent: dict = {}
    form = None
    for frame in frames:
        form = frame.iloc[:0]
        for pair in zip(frame["v"].tolist(), frame["u"].tolist(), strict=True):
            roots = []
            for x in pair:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[up]
                roots.append(x)
            parent[max(roots)] = min(roots)
    rows = []
    for x in sorted(parent):  # a parent is less than its node, so it is at its root by then
        parent[x] = parent[parent[x]]
        if parent[x] != x:
            rows.append((x, parent[x]))
    if rows:
        yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=form[c].dtype) for i, c in enumerate(("v", "u"))})


def components(edges: DataFrame, ids: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """id, component (its least id), of undirected edges(src, dst).

    Edges of whole numbers or strings are settled by a union-find in one task as soon as at most `most` are left, which often is at the start.
    Alternating star contraction: the large star of a node links its greater neighbours to the least of its neighbourhood,
    the small star links its lesser ones, until the edges are stars around their least id; few rounds even for long
    paths. Neighbourhoods are reduced to their least id by partial aggregation, and the join back to the edges of a hub
    is split by AQE. Each half round is written to the shared folder; what a round costs falls with the edges
    that are left. ids adds nodes without an edge; edges with a NULL end leave.
    """
    clean = edges.select("src", "dst").filter("src is not null and dst is not null")
    nodes = clean.select(F.explode(F.array("src", "dst")).alias("id"))
    if ids is not None:
        nodes = nodes.unionByName(ids.select("id").filter("id is not null"))
    # v > u: each edge once, the greater end first
    link = lambda df: df.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).filter("v <> u").distinct()
    star = cut(link(clean))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    before = mark(star)
    simple = all(isinstance(f.dataType, (IntegralType, StringType)) for f in star.schema)
    while True:
        if simple and before[0] <= most:
            star = star.coalesce(1).mapInPandas(_union_find, star.schema)
            break
        both = star.unionByName(star.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        least = least.select("c", F.least("c", "m").alias("m"))
        large = both.join(least, F.col("v") == F.col("c")).filter("u > v")
        star = cut(link(large.select(F.col("u").alias("src"), F.col("m").alias("dst"))))
        lower = star.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        small = star.join(lower, F.col("v") == F.col("c"))
        to_least = small.select(F.col("u").alias("src"), F.col("m").alias("dst")).unionByName(small.select(F.col("v").alias("src"), F.col("m").alias("dst")))
        star = cut(link(to_least))
        after = mark(star)
        if after == before:
            break
        before = after
    roots = star.select(F.col("v").alias("__v"), F.col("u").alias("__u"))
    return nodes.distinct().join(roots, F.col("id") == F.col("__v"), "left").select("id", F.coalesce("__u", "id").alias("component"))


def clusters(points: DataFrame, key: str, x: str, y: str, distance: float) -> DataFrame:
    """id, component (its least id): points chained by steps of at most `distance`, the components of joins.band_pairs without its pairs.

    Points fall into square cells whose diagonal is below the distance, so those of a cell belong together and the graph is one of cells: its
    size follows the cells that are filled, however many points lie in each. Two cells at most two apart are linked where the points of both that
    lie farthest towards the other are near enough. Only cells that no chain of such links joins are compared point by point, and of their points those
    within reach of the other cell's box. Points with a NULL, NaN or infinite coordinate are alone; NULL keys leave; a key that occurs twice joins its places.
    Coordinates of 2^50 cells or more are an error, as doubles no longer tell the places in a cell apart.
    """
    if distance <= 0:
        raise ValueError("distance must be positive")
    size = 0.7 * distance
    every = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("id is not null")
    real = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    at = lambda c: F.when(F.abs(F.col(c) / size) < 2.0**50, F.floor(F.col(c) / size)).otherwise(F.raise_error(F.lit("coordinate too large for the distance")).cast("long"))
    every = every.withColumn("cx", F.when(real, at("x"))).withColumn("cy", F.when(real, at("y")))
    placed = every.filter("cx is not null")
    ways = (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y"))
    spot = F.struct("x", "y")
    cells = cut(placed.groupBy("cx", "cy").agg(
        F.min("id").alias("node"), F.array(*[F.max_by(spot, w) for w in ways]).alias("last"), F.array(*[F.min_by(spot, w) for w in ways]).alias("first")
    ))
    box = lambda tag: [F.col("first")[0]["x"].alias(f"{tag}x0"), F.col("last")[0]["x"].alias(f"{tag}x1"), F.col("first")[1]["y"].alias(f"{tag}y0"), F.col("last")[1]["y"].alias(f"{tag}y1")]
    # each two cells once: to the right, or straight up; `way` is the direction in which the second lies
    steps = [(i, j, 0 if j == 0 else 1 if i == 0 else 2 if j > 0 else 3) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("way")) for i, j, w in steps]))
    left = cells.select("*", step.alias("s")).select(
        F.col("node").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), *box("a"), F.col("last")[F.col("s.way")].alias("p"), F.col("s.way").alias("way"),
        (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"),
    )
    met = left.join(cells.select("cx", "cy", F.col("node").alias("b"), *box("b"), "first"), ["cx", "cy"])
    gap = lambda c: F.greatest(F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"), F.lit(0.0))
    near = lambda dx, dy: dx * dx + dy * dy <= distance * distance
    q = F.col("first")[F.col("way")]
    met = met.filter(near(gap("x"), gap("y"))).withColumn("sure", near(F.col("p.x") - q["x"], F.col("p.y") - q["y"])).drop("p", "way", "first")
    met = cut(met.withColumnsRenamed({"cx": "bx", "cy": "by"}))
    spread = placed.groupBy("id").agg(*[f(c).alias(f"{n}{c}") for c in ("cx", "cy") for n, f in (("l", F.min), ("h", F.max))]).filter("lcx <> hcx or lcy <> hcy")
    twice = placed.join(spread, "id", "left_semi").join(cells.select("cx", "cy", "node"), ["cx", "cy"]).select(F.col("id").alias("src"), F.col("node").alias("dst"))
    linked = cut(components(met.filter("sure").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(twice), cells.select(F.col("node").alias("id"))))
    of = lambda tag: linked.select(F.col("id").alias(tag), F.col("component").alias(f"{tag}_component"))
    apart = cut(met.filter("not sure").join(of("a"), "a").join(of("b"), "b").filter("a_component <> b_component"))
    if apart.limit(1).count():
        pick = lambda tag: placed.select(F.col("cx").alias(f"{tag}x"), F.col("cy").alias(f"{tag}y"), F.col("x").alias(f"{tag}px"), F.col("y").alias(f"{tag}py"))
        away = lambda tag, c, other: F.greatest(F.col(f"{other}{c}0") - F.col(f"{tag}p{c}"), F.col(f"{tag}p{c}") - F.col(f"{other}{c}1"), F.lit(0.0))
        tried = apart.join(pick("a"), ["ax", "ay"]).filter(near(away("a", "x", "b"), away("a", "y", "b"))).join(pick("b"), ["bx", "by"])
        tried = tried.filter(near(F.col("apx") - F.col("bpx"), F.col("apy") - F.col("bpy"))).select(F.col("a_component").alias("src"), F.col("b_component").alias("dst"))
        more = components(cut(tried.distinct())).select(F.col("id").alias("component"), F.col("component").alias("__whole"))
        linked = linked.join(more, "component", "left").select("id", F.coalesce("__whole", "component").alias("component"))
    of_cell = cells.select("cx", "cy", "node").join(linked.select(F.col("id").alias("node"), "component"), "node").select("cx", "cy", "component")
    return every.join(of_cell, ["cx", "cy"], "left").groupBy("id").agg(F.coalesce(F.min("component"), "id").alias("component"))

"""Deeply nested records as related flat tables, linked by interval labels.

Every JSON node of a record gets a pre-order and a post-order number by one depth-first traversal. Nodes that stand
for an entity (record, object, detection, violation by default) become rows; a node is inside another one exactly if
pre_outer < pre_inner and post_outer > post_inner, so any two levels can be joined without the levels between them.

Parsing stays in Arrow batches, one pass over the text; all that follows is declarative and keyed by record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_DDL = (
    "record_id long, node_type string, pre int, post int, depth int, array_no int, label string, attributes string"
)


@dataclass(frozen=True)
class Entity:
    """An entity type, the paths of the arrays that may hold it, and the field that a bare string stands for.

    Of several paths the first whose array has elements counts.
    """

    name: str
    paths: tuple[tuple[str, ...], ...] = ()
    label: str | None = None
    children: tuple[Entity, ...] = field(default_factory=tuple)


CHIP_RECORD = Entity(
    "record",
    label="parcel_id",
    children=(
        Entity(
            "object",
            (("detected_objects",),),
            "object_class",
            (
                Entity(
                    "detection",
                    (("result", "detections"), ("detections",)),
                    None,
                    (Entity("violation", (("violations",),), "violation_id"),),
                ),
            ),
        ),
    ),
)

_DECODER = json.JSONDecoder()


def _holds(value: Any) -> bool:
    return isinstance(value, dict) or (isinstance(value, list) and any(isinstance(x, (dict, list)) for x in value))


def relaxed_json(text: str | None) -> Any:
    """The first JSON object, or array of objects, in a text; None if there is none.

    Byte-order marks, fences and prose around it are passed over. After a start that fails, the search goes on behind
    the place where it failed, so the work stays linear in the length of the text.
    """
    if not text:
        return None
    try:
        value = json.loads(text.strip().lstrip("﻿"))
        if isinstance(value, (dict, list)):
            return value
        if isinstance(value, str) and value != text:
            return relaxed_json(value)
        return None
    except (ValueError, RecursionError):
        pass
    at = 0
    while True:
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            return None
        start = min(starts)
        try:
            value, end = _DECODER.raw_decode(text, start)
            if _holds(value):
                return value
            at = end
        except RecursionError:
            return None
        except json.JSONDecodeError as e:
            at = max(start + 1, e.pos)


def _as_json(value: Any) -> Any:
    """A string that holds JSON as that JSON, any other value as it is."""
    if isinstance(value, str) and ("{" in value or "[" in value or value.strip() == "null"):
        if value.strip() == "null":
            return None
        found = relaxed_json(value)
        return value if found is None else found
    return value


def _elements(value: Any) -> list[Any]:
    value = _as_json(value)
    if value is None or value == "":
        return []
    return value if isinstance(value, list) else [value]


def _scalar(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def interval_nodes(root: Any, spec: Entity = CHIP_RECORD) -> list[tuple[str, int, int, int, int, str | None, str]]:
    """(node_type, pre, post, depth, array_no, label, attributes) of the entities below a parsed record.

    The traversal is iterative, so depth is bounded by memory only. Attributes are the node's own scalar fields as
    JSON. Numbers count all nodes, also those that are no entity.
    """
    out: list[tuple[str, int, int, int, int, str | None, str]] = []
    pre = post = 0
    # frames: value, entity of this value or None, its position, the entities its arrays may hold, depth
    stack: list[list[Any]] = [[root, spec, 0, None, 0, None, None]]
    while stack:
        frame = stack[-1]
        value, entity, position, inside, depth, todo, number = frame
        if todo is None:
            frame[6] = number = pre
            pre += 1
            frame[5] = todo = iter(_children(value, entity, inside))
        for child_value, child_entity, child_position, child_inside in todo:
            stack.append([child_value, child_entity, child_position, child_inside, depth + 1, None, None])
            break
        else:
            stack.pop()
            if entity is not None:
                fields = value if isinstance(value, dict) else {}
                label = fields.get(entity.label) if entity.label else None
                if isinstance(value, str):
                    label = value
                own = {k: v for k, v in fields.items() if not isinstance(v, (dict, list))}
                out.append(
                    (entity.name, number, post, depth, position, _scalar(label), json.dumps(own, ensure_ascii=False))
                )
            post += 1
    return out


def _children(value: Any, entity: Entity | None, inside: Any) -> Iterator[tuple[Any, Entity | None, int, Any]]:
    """The nodes below a node, each with its entity, its position and what its own arrays may hold.

    inside: for an array that holds entities, (entity,); for an object on the way to such an array, a dict from field
    to (entity, rest of the path).
    """
    if entity is not None:
        ways: dict[str, list[tuple[Entity, tuple[str, ...]]]] = {}
        for child in entity.children:
            path = _chosen(value, child)
            if path:
                ways.setdefault(path[0], []).append((child, path[1:]))
        inside = ways
    if isinstance(inside, tuple):  # an array of entities
        for i, x in enumerate(_elements(value)):
            x = _as_json(x)
            is_node = isinstance(x, dict) or (isinstance(x, str) and x.strip() and inside[0].label is not None)
            yield x, inside[0] if is_node else None, i, None
    elif isinstance(value, dict):
        for key, x in value.items():
            way = (inside or {}).get(key)
            if not way:
                yield x, None, 0, None
                continue
            child, rest = way[0]
            if rest:
                yield _as_json(x), None, 0, {rest[0]: [(child, rest[1:])]}
            else:
                yield x, None, 0, (child,)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield x, None, i, None


def _chosen(value: Any, child: Entity) -> tuple[str, ...] | None:
    """The first of the child's paths whose array has elements."""
    for path in child.paths:
        at = value
        for key in path:
            at = _as_json(at)
            at = at.get(key) if isinstance(at, dict) else None
        if _elements(at):
            return path
    return None


def nodes(records: DataFrame, key: str = "record_id", payload: str = "payload", spec: Entity = CHIP_RECORD) -> DataFrame:
    """One row per entity of every record, with its interval labels (NODE_DDL).

    Records sent again count once: of the rows of one key the least payload is kept, NULL payloads only if there is no
    other, by partial aggregation before the shuffle. A record whose text holds no JSON object gives one record node
    with the label NULL and attributes NULL; rows with a NULL key leave. Null array elements keep their position but
    give no node. An array at the top is read as that many records' first object.
    """
    unique = (
        records.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("record_id"))
        .agg(F.min(payload).alias("payload"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["node_type", "pre", "post", "depth", "array_no", "label", "attributes"]
        for batch in batches:
            ids, rows = [], []
            for record_id, text in zip(batch["record_id"], batch["payload"], strict=True):
                value = relaxed_json(text)
                if isinstance(value, list):
                    value = next((x for x in value if isinstance(x, dict)), None)
                found = interval_nodes(value, spec) if value is not None else [("record", 0, 0, 0, 0, None, None)]
                rows += found
                ids += [record_id] * len(found)
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "record_id", ids)
            yield out.astype({"record_id": "int64", "pre": "int32", "post": "int32", "depth": "int32", "array_no": "int32"})

    return unique.mapInPandas(run, NODE_DDL)


def of_type(node_rows: DataFrame, node_type: str) -> DataFrame:
    """The table of one entity type."""
    return node_rows.filter(F.col("node_type") == node_type).drop("node_type")


def contains(outer: str, inner: str) -> Column:
    """Interval containment between two aliased node tables, with the equality that makes it a hash join."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (o("record_id") == i("record_id")) & (o("pre") < i("pre")) & (o("post") > i("post"))


def with_ancestors(node_rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """node_rows with <type>_pre, <type>_no and <type>_label of the nearest enclosing node of each type (NULL if none).

    One sorted sweep per record instead of a join per level: intervals of one type never overlap here, so the last node
    of a type that began before encloses this one exactly if it ends after it. A record's nodes come from one text, so
    the sweep never sees more than one record at a time.
    """
    sweep = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = node_rows
    for t in types:
        last = F.last(
            F.when(F.col("node_type") == t, F.struct("pre", "post", "array_no", "label")), ignorenulls=True
        ).over(sweep)
        out = out.withColumn(f"__{t}", last)
    for t in types:
        inside = (F.col(f"__{t}.post") >= F.col("post")) & (F.col(f"__{t}.pre") <= F.col("pre"))
        for source, name in (("pre", "pre"), ("array_no", "no"), ("label", "label")):
            out = out.withColumn(f"{t}_{name}", F.when(inside, F.col(f"__{t}.{source}")))
    return out.drop(*[f"__{t}" for t in types])

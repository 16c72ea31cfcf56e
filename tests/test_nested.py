from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.operators import nested


def brute(payload):
    """Violations with their positions, by plain recursion over the parsed text."""

    def value(v):
        return nested._as_json(v)

    def array(v):
        v = value(v)
        return [] if v is None or v == "" else v if isinstance(v, list) else [v]

    out = []
    root = nested.relaxed_json(payload)
    if not isinstance(root, dict):
        return out
    for i, o in enumerate(array(root.get("detected_objects"))):
        o = value(o)
        if isinstance(o, dict):
            r = value(o.get("result"))
            found = array(r.get("detections")) if isinstance(r, dict) else []
            for j, d in enumerate(found or array(o.get("detections"))):
                d = value(d)
                if isinstance(d, dict):
                    for k, v in enumerate(array(d.get("violations"))):
                        v = value(v)
                        if isinstance(v, dict):
                            out.append((i, j, k, v.get("violation_id")))
                        elif isinstance(v, str) and v.strip():
                            out.append((i, j, k, v))
    return out


violation = st.one_of(st.none(), st.fixed_dictionaries({"violation_id": st.sampled_from(["V_A", "V_B"])}, optional={"x": st.just({"y": [1, {"z": 2}]})}))
violations = st.one_of(st.none(), violation, st.lists(violation, max_size=3), st.lists(violation, max_size=2).map(json.dumps))
detection = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"violations": violations, "zone": st.just("Z")}))
detections = st.one_of(st.none(), detection, st.lists(detection, max_size=3), st.lists(detection, max_size=2).map(json.dumps))
thing = st.one_of(st.none(), st.just("plain_name"), st.fixed_dictionaries({"object_class": st.just("c")}, optional={"detections": detections, "result": st.fixed_dictionaries({}, optional={"detections": detections})}))
records = st.fixed_dictionaries({}, optional={"detected_objects": st.one_of(st.none(), thing, st.lists(thing, max_size=4)), "meta": st.just({"a": [{"b": 1}]})})


@settings(max_examples=200, deadline=None)
@given(records)
def test_intervals_nest_and_find_every_violation(record):
    rows = nested.interval_nodes(record)
    assert len({r[1] for r in rows}) == len(rows) and len({r[2] for r in rows}) == len(rows)
    for a in rows:
        for b in rows:
            inside = a[1] < b[1] and a[2] > b[2]
            apart = (a[1] < b[1]) == (a[2] < b[2]) or a is b
            assert inside or apart or (b[1] < a[1] and b[2] > a[2])
    by = {r[1]: r for r in rows}
    found = []
    for v in rows:
        if v[0] == "violation":
            up = {r[0]: r for r in rows if r[1] < v[1] and r[2] > v[2]}
            assert set(up) == {"record", "object", "detection"}
            found.append((up["object"][4], up["detection"][4], v[4], v[5]))
    assert by and sorted(found, key=str) == sorted(brute(json.dumps(record)), key=str)


def test_table(spark):
    good = json.dumps({"detected_objects": [None, {"object_class": "c", "detections": {"violations": [None, {"violation_id": "V"}]}}]})
    data = [(1, good, "x"), (1, good, "x"), (2, "```json\n" + good + "\n```", "x"), (3, "﻿" + good, "x"), (4, None, "x"), (5, "", "x"), (6, "nothing [here]", "x"),
            (7, "{" * 2000, "x"), (None, good, "x"), (8, json.dumps(good), "x"), (9, "note [1] {\"detected_objects\": []} end", "x")]
    df = spark.createDataFrame(data, "record_id long, payload string, node_type string")
    node = nested.nodes(df)
    assert node.filter("node_type = 'record'").count() == 9
    got = nested.with_ancestors(node, ("object", "detection")).filter("node_type = 'violation'")
    rows = sorted((r["record_id"], r["object_no"], r["detection_no"], r["array_no"], r["label"]) for r in got.collect())
    assert rows == [(i, 1, 0, 1, "V") for i in (1, 2, 3, 8)]
    assert nested.nodes(df.limit(0)).count() == 0
    o, v = nested.of_type(node, "object").alias("o"), nested.of_type(node, "violation").alias("v")
    assert o.join(v, nested.contains("o", "v")).count() == 4


def test_deep_and_long():
    deep = {"detected_objects": [{"meta": "x"}]}
    at = deep
    for _ in range(900):
        at["n"] = {}
        at = at["n"]
    assert len(nested.interval_nodes(deep)) == 2
    assert nested.relaxed_json("[" * 100_000) is None


def test_found_against_recursion(spark, sf):
    from emberline.plans.nested_records import p3_found

    rows = {tuple(r) for r in p3_found(spark, sf).collect()}
    raw = {(r["record_id"], r["payload"]) for r in spark.read.parquet(f"{sf}/vlm_raw_records.parquet").collect()}
    assert rows == {(i, *v) for i, p in raw for v in brute(p)} and rows

"""Walks with paths, the publication, bundle and layer gates."""

import json

import pytest

from gridlark.operators import walk


def reference_walk(value, path=""):
    if isinstance(value, dict):
        for key, child in sorted(value.items()):
            at = f"{path}.{key}" if path else key
            yield at, key, child if isinstance(child, str) else None
            yield from reference_walk(child, at)
    elif isinstance(value, list):
        for k, child in enumerate(value):
            if isinstance(child, str):
                yield f"{path}[{k}]", None, child
            yield from reference_walk(child, f"{path}[{k}]")


def test_walk_gives_every_field_with_its_path(spark):
    documents = [{}, {"a": 1}, {"a": {"b": [1, {"c": "x", "d": [[{"e": None}], "text"]}], "é.f": "y"}, "z": ["q", []]}, [{"top": "list"}, "s"], 5, {"deep": [[[[[{"x": {"y": "z"}}]]]]]}]
    rows = [(k, json.dumps(d)) for k, d in enumerate(documents)]
    from pyspark.sql import functions as F

    t = spark.createDataFrame(rows, "n int, text string").withColumn("v", F.parse_json("text"))
    got = {r.n: sorted(((e.path, e.key, e.text) for e in r.entries), key=str) for r in walk.walked(t).collect()}
    assert got == {k: sorted(reference_walk(d), key=str) for k, d in enumerate(documents)}
    assert {r[0]: r[1] for r in t.select("n", walk.nesting(F.col("text"))).collect()} == {0: 1, 1: 1, 2: 7, 3: 2, 4: 0, 5: 8}


def public(**more):
    return {"sanitized": True, "is_demo": True, "source_id": "src-1"} | more


def test_public_findings_have_paths(spark):
    records = [
        public(), public(decoded={"list": [{"Api-Token": 1}, {"note": "from 192.0.2.7"}]}), public(source_id="10.0.0.1", source_ip="x"), {"source_id": " "}, public(is_demo=1, sanitized="yes"), public(tags=["a", "2001:db8::1"]), public(secret={"password": {"x": 1}}),
    ]
    lines = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "{"), (91, "[1]"), (92, " \t "), (93, "7"), (94, "[" * 60 + "]" * 60), (95, json.dumps(public(x=json.loads('{"a":' * 60 + "1" + "}" * 60))))]
    found = walk.public_findings(spark.createDataFrame(lines, "line_no long, value string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.line_no, r.place_no)):
        got.setdefault(r.line_no, []).append((r.code, r.place))
    assert got == {
        1: [("forbidden_field", "decoded.list[0].Api-Token"), ("address_found", "decoded.list[1].note")],
        2: [("source_id_is_address", "source_id"), ("address_found", "source_id"), ("forbidden_field", "source_ip")],
        3: [("not_sanitized", "sanitized"), ("no_classification", "is_demo"), ("no_source_id", "source_id")],
        4: [("not_sanitized", "sanitized"), ("no_classification", "is_demo")],
        5: [("address_found", "tags[1]")],
        6: [("forbidden_field", "secret"), ("forbidden_field", "secret.password")],
        90: [("malformed_json", "")], 91: [("record_not_object", "")], 93: [("record_not_object", "")], 94: [("record_not_object", "")], 95: [("nested_too_deep", "")],
    }
    message = {r.message for r in found}
    assert {"record 1: forbidden field decoded.list[0].Api-Token", "line 90: malformed JSON", "record 5: address or network prefix found in tags[1]"} <= message
    assert not any("192.0.2.7" in m or "10.0.0.1" in m for m in message)


def test_require_public_reports_the_first_ten(spark):
    make = lambda rows: spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows, 1)], "line_no long, value string")
    good = make([public(), public(), "  "])
    assert walk.require_public(good) is good
    with pytest.raises(walk.PublicationError) as e:
        walk.require_public(make([public(sanitized=False)] + ["{"] * 12))
    assert len(e.value.errors) == 10 and e.value.errors[0] == "line 2: malformed JSON"
    with pytest.raises(walk.PublicationError, match="record 1: sanitized flag is not true; record 2: forbidden field payload"):
        walk.require_public(make([public(sanitized=False), public(payload="x")]))
    with pytest.raises(walk.PublicationError, match="empty"):
        walk.require_public(make([""]))
    with pytest.raises(walk.PublicationError, match="mixed"):
        walk.require_public(make([public(), public(is_demo=False)]))


def test_bundle_gate(spark):
    objects = [{"type": "identity", "id": "identity--1"}, {"type": "x", "extra": {"payload_bin": "AA==", "value": "198.51.100.3"}}, [1], {"id": 1}]
    got = walk.bundle_findings(spark.createDataFrame([(k, json.dumps(o)) for k, o in enumerate(objects)], "number long, value string")).collect()
    assert sorted((r.number, r.message) for r in got) == [
        (1, "address or network prefix found in STIX field objects[1].extra.value"), (1, "forbidden STIX field objects[1].extra.payload_bin"), (2, "objects[2] is no object with a type"), (3, "objects[3] is no object with a type"),
    ]


def test_layer_gate(spark):
    technique = {"techniqueID": "T0877", "score": 3, "comment": "c"}
    good = {"name": "n", "domain": "ics-attack", "versions": {"layer": "4.5", "navigator": "5.3.2"}, "techniques": [technique]}
    layers = {
        "good": good, "empty": {}, "version": good | {"versions": {"layer": "4.5", "navigator": "4.8.9"}}, "odd": good | {"versions": {"layer": "4.5", "navigator": "5.x"}}, "ids": good | {"techniques": [technique | {"techniqueID": "T9999"}, technique | {"score": -1, "comment": None}, technique | {"score": 1.5}]},
        "leak": good | {"metadata": [{"name": "source_id", "value": "at 192.0.2.9"}]}, "short": good | {"versions": {"layer": "4.5", "navigator": "5"}},
    }
    rows = [(k, json.dumps(v)) for k, v in layers.items()] + [("broken", "{")]
    got = {}
    for r in sorted(walk.layer_findings(spark.createDataFrame(rows, "layer_id string, value string")).collect(), key=lambda r: (r.layer_id, r.place_no)):
        got.setdefault(r.layer_id, []).append(r.message)
    assert got == {
        "empty": ["name is required", "domain must be ics-attack", "versions.layer must be 4.5", "versions.navigator must be at least 4.9.0", "techniques must be a list"],
        "version": ["versions.navigator must be at least 4.9.0"], "odd": ["versions.navigator must be at least 4.9.0"],
        "ids": ["techniques[0] has an unsupported techniqueID", "techniques[1].score must be a non-negative integer", "techniques[1].comment must be a string", "techniques[2].score must be a non-negative integer"],
        "leak": ["layer contains a forbidden identifier or payload key", "layer contains an IP address literal"], "broken": ["layer is no JSON"],
    }

"""Saved views, selections, exact medians, cases and settings."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridlark.operators import workspace
from gridlark.plans.detection import PACK
from gridlark.sources import cases, jsonl
from gridlark.sources.rules import read_pack


def test_view_round_trip_and_tampering(spark):
    schema = "protocol string, severity string, source_country string, mapping_confidence string, triage_score int, operation string, observed_epoch long, source_id string, source_latitude double, source_longitude double"
    rows = [("s7", "high", "A", "low", 60, "write_single", 10 * 86400, "s", 1.0, 2.0), ("s7", "high", None, "low", 60, "device_probe", 9 * 86400, None, None, 2.0), (None, "info", "B", "none", 0, None, None, "t", 95.0, 0.0)]
    t = spark.createDataFrame(rows, schema)
    view = workspace.View({"protocols": ["s7", "", "s7"], "countries": []}, window="Last 7 days", selection={"source": "s", "country": None, "protocol": "s7", "events": "x", "sessions": 4.9, "secret": 1})
    saved = workspace.to_snapshot(t, workspace.View({"protocols": ["s7", ""]}, window="Last 7 days", selection=view.selection), True)
    again = workspace.from_snapshot(saved)
    assert again.chosen == {"protocols": ["s7"]} and again.apply(t).count() == 2
    assert again.selection == {"source": "s", "country": "", "protocol": "s7", "events": 0, "sessions": 4, "max_severity": "", "first_seen": "", "last_seen": "", "control_attempts": 0, "techniques": ""}
    assert json.loads(saved)["aggregate_counts"] == {"filtered_events": 2, "mapped_events": 1, "excluded_events": 1, "mapped_sources": 1, "mapped_countries": 1}
    assert view.apply(t).count() == 0  # an empty list lets nothing through
    assert workspace.manifest(t.limit(0), again, False)["aggregate_counts"]["filtered_events"] == 0
    for change, kind in (({"schema_version": "v0"}, ValueError), ({"filters": None}, TypeError), ({"filters": {"window": "For ever"}}, ValueError), ({"filters": {"window": "Last 7 days", "protocols": ["modbus"], "control_only": False}}, ValueError)):
        with pytest.raises(kind):
            workspace.from_snapshot(json.dumps(json.loads(saved) | change))
    assert workspace.safe_list("text") == [] and workspace.safe_list({3, "b", ""}) == ["3", "b"] and workspace.safe_selection({"source": 1}) is None
    got = spark.createDataFrame([(["b", "", "a", "b", None],), (None,)], "x array<string>").select(workspace.safe_texts(F.col("x"))).collect()
    assert [r[0] for r in got] == [["a", "b"], []]


def test_exact_medians(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([round(rng.uniform(-90, 90), 3), 7.5, None, float("nan")])) for _ in range(3000)] + [("two", 1.0), ("two", 2.0), ("one", -0.5), ("same", 4.0), ("same", 4.0), ("none", None), (None, 3.0)]
    got = {r.k: r.median for r in workspace.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    held = {}
    for k, v in rows:
        if v is not None and v == v:
            held.setdefault(k, []).append(v)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(statistics.median(v), 9) for k, v in held.items()}
    assert workspace.exact_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_change_text(spark):
    make = lambda rows: spark.createDataFrame(rows, "metric string, current_window long, previous_window long, change long")
    assert workspace.change_text(make([])) == "There are no windows to compare."
    assert workspace.change_text(make([("Events", 3, 3, 0)])) == "No count changed between the windows."
    text = workspace.change_text(make([("Events", 12000, 3, 11997), ("Sessions", 2, 2, 0), ("Control actions", 5, 0, 5), ("Mapped sources", 0, 1, -1)]))
    assert text.startswith("Events up by 11,997 (3 to 12,000); Control actions: 5 now, none before. ")


def fixture(case_id, event, **expected):
    return json.dumps({"case_id": case_id, "event": event, "expected": {"sigma": [], "wazuh": [], "suricata": []} | expected})


def test_pack_findings(spark):
    write = {"sensor_id": "s", "event_type": "protocol_request", "protocol": "modbus", "decoded": {"operation": "write_single", "function_code": 6}}
    pack = read_pack(PACK)
    rows = [fixture("w", write, sigma=["gl_modbus_write"], wazuh=["110101"], suricata=["4210501"]), fixture("w", {}), fixture("bad", write, sigma=["gl_nothing"]), fixture("quiet", {"event_type": "connection"}), "{", " ", json.dumps({"case_id": "", "event": 5, "expected": {"sigma": []}})]
    lines = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows, 1)], "file string, line_no long, value string")
    errors = {(r.line_no, r.code) for r in cases.fixture_errors(lines).collect()}
    assert errors == {(2, "duplicate_case_id"), (5, "invalid_json"), (7, "case_id_missing"), (7, "event_not_object"), (7, "expected_engines")}
    found = {(r.code, r.subject) for r in cases.pack_findings(lines.where("line_no in (1, 3, 4)"), pack).collect()}
    names = cases.rule_names(pack)
    uncovered = {("no_positive_case", f"{e} {n}") for e, own in names.items() for n in own} - {("no_positive_case", s) for s in ("sigma gl_modbus_write", "wazuh 110101", "suricata 4210501")}
    assert found == uncovered | {("unknown_rule", "sigma gl_nothing"), ("mismatch", "bad Sigma"), ("mismatch", "bad Wazuh"), ("mismatch", "bad Suricata"), ("too_few_negative_cases", "")}
    assert cases.pack_summary(lines.where("line_no in (1, 3, 4)"), pack)["negative_cases"] == 1
    assert {r.code for r in cases.pack_findings(lines.limit(0), pack).collect()} == {"no_fixtures", "too_few_negative_cases", "no_positive_case"}


def test_labelled_cases_and_public_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event":{"x":1},"expected_technique_ids":["T1"]}\n\n{"event":{},"expected_technique_ids":[]}\n')
    got = cases.load_labelled(spark, f"file://{tmp_path}/a.jsonl").orderBy("line_no").collect()
    assert [(r.line_no, r.event, r.expected_technique_ids) for r in got] == [(1, '{"x":1}', ["T1"]), (3, "{}", [])]
    (tmp_path / "b.jsonl").write_text('{"event":{}}\n')
    with pytest.raises(Exception, match="line 1 has no expected_technique_ids"):
        cases.load_labelled(spark, f"file://{tmp_path}/b.jsonl").collect()
    (tmp_path / "p.jsonl").write_text('{"sanitized":true,"is_demo":true,"source_id":"s"}\n')
    assert jsonl.read_public(spark, f"file://{tmp_path}/p.jsonl").count() == 1
    with pytest.raises(ValueError, match="record 1: sanitized flag is not true"):
        jsonl.read_public(spark, f"file://{tmp_path}/b.jsonl")
    points = spark.createDataFrame([("s", "secret", 3)], "source string, source_ip string, events long")
    assert jsonl.public_points(points).columns == list(jsonl.POINT_COLUMNS)


def test_alert_settings():
    good = {"enabled": True, "webhook_url": "https://example.org/x", "queue_size": 5, "timeout_seconds": 2}
    assert cases.alert_settings(json.dumps(good).encode()).queue_size == 5 and cases.alert_settings(b"{}") == cases.AlertSettings()
    assert cases.alert_settings(json.dumps(good | {"webhook_url": "http://127.0.0.1:9/x"}).encode()).enabled
    for bad in ({"other": 1}, {"enabled": "yes"}, {"queue_size": 0}, {"queue_size": True}, {"timeout_seconds": 16}, {"secret_env": "HOME"}, {"enabled": True, "webhook_url": ""}, {"enabled": True, "webhook_url": "http://example.org"}):
        with pytest.raises((ValueError, TypeError)):
            cases.alert_settings(json.dumps(bad).encode())
    with pytest.raises(ValueError, match="64"):
        cases.alert_settings(b" " * 70_000)

"""Contracts and the migration of mixed records."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridlark.operators import contracts
from gridlark.operators.contracts import ANALYSIS, OBSERVATION
from gridlark.sources.commits import Commit


def observation(**more):
    return {"schema_version": OBSERVATION.version, "event_id": "e", "session_id": "s", "sensor_id": "x", "observed_at": "2024", "protocol": "modbus", "event_type": "connection", "capture": {}, "data_classification": "synthetic"} | more


def analysis(**more):
    return {"schema_version": ANALYSIS.version, "analysis_id": "a", "analysis_run_id": "r", "event_id": "e", "input_digest": "d", "executed_at": "t", "versions": {}, "attack_hypotheses": [], "detection_results": []} | more


def without(record, name):
    return {k: v for k, v in record.items() if k != name}


def test_first_violation(spark):
    cases = [
        (OBSERVATION, observation(), None), (OBSERVATION, observation(schema_version="v0", event_id=""), "unsupported_schema"), (OBSERVATION, without(observation(), "protocol"), "missing_fields"), (OBSERVATION, observation(event_id=""), "empty_text"), (OBSERVATION, observation(sensor_id=5), "empty_text"),
        (OBSERVATION, without(observation(), "capture"), "not_an_object"), (OBSERVATION, observation(capture=[]), "not_an_object"), (OBSERVATION, observation(data_classification="public"), "bad_value"), (OBSERVATION, without(observation(), "data_classification"), "bad_value"), (OBSERVATION, observation(severity=None), "forbidden_field"),
        (ANALYSIS, analysis(), None), (ANALYSIS, without(analysis(), "versions"), "missing_fields"), (ANALYSIS, analysis(analysis_id=None), "empty_text"), (ANALYSIS, analysis(versions="v"), "not_an_object"), (ANALYSIS, analysis(attack_hypotheses={}), "not_a_list"),
    ]
    for contract in (OBSERVATION, ANALYSIS):
        own = [(k, json.dumps(r), want) for k, (c, r, want) in enumerate(cases) if c is contract]
        t = spark.createDataFrame(own, "n int, text string, want string").withColumn("v", F.parse_json("text"))
        got = t.select("n", "want", contract.violation(F.col("v")).alias("got")).collect()
        assert {r.n: r.got for r in got} == {r.n: r.want for r in got}


def event(**more):
    return {"event_id": "e1", "session_id": "s", "sensor_id": "x", "observed_at": "2024-01-01T00:00:00+00:00", "protocol": "modbus", "event_type": "connection", "decoded": {"note": "é \"q\"", "n": 1.5}, "is_demo": False} | more


def legacy_pair(record):
    """The two contracts of a mixed record, in plain Python."""
    o = {k: v for k, v in record.items() if k not in contracts.ANALYTIC_FIELDS}
    o |= {"schema_version": OBSERVATION.version, "data_classification": "synthetic" if record.get("is_demo") is True else "sanitized_private" if record.get("sanitized") is True else "raw_private", "capture": {"sensor_version": "legacy-v0", "legacy_import": True}}
    if not any(k in record for k in contracts.ANALYTIC_FIELDS):
        return o, None
    digest = hashlib.sha256(json.dumps(o, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return o, {
        "schema_version": ANALYSIS.version, "analysis_id": f"legacy-{record['event_id']}", "analysis_run_id": "legacy-import-v0", "event_id": record["event_id"], "input_digest": digest, "executed_at": record["observed_at"],
        "versions": {"mapper": "legacy-v0", "triage": "legacy-v0", "rule_catalog": "legacy-v0"}, "attack_hypotheses": record.get("techniques", []), "severity": record.get("severity", "info"), "triage": record.get("triage", {}), "detection_results": record.get("detection_results", []), "evidence_completeness": {},
    }


def test_migration(spark, tmp_path):
    records = [event(), event(event_id="e2", techniques=[{"technique_id": "T0877"}], severity="high"), event(event_id="e3", severity=None, sanitized=True), event(event_id='e"4', is_demo=True, capture="old", triage={"score": 5}), observation(), analysis(), observation(event_id="")]
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records, 1)] + [(50, " ")], "line_no long, value string")
    got = {r.line_no: r for r in contracts.migrated(lines).collect()}
    assert len(got) == 7 and all(r.error is None for r in got.values())
    load = lambda text: None if text is None else json.loads(text)
    for k, record in enumerate(records[:4], 1):
        assert (load(got[k].observation), load(got[k].analysis)) == legacy_pair(record)
    assert (load(got[5].observation), got[5].analysis) == (observation(), None) and (got[6].observation, load(got[6].analysis)) == (None, analysis())
    assert load(got[7].observation) == observation(event_id="")  # versioned records go through as they are
    counts = {"observations": 6, "analyses": 4}
    assert contracts.migrate(spark, lines, None) == counts and not list(tmp_path.iterdir())
    folder = f"file://{tmp_path}/out"
    assert contracts.migrate(spark, lines, folder) == counts == contracts.migrate(spark, lines, folder)
    assert Commit(spark, folder, "migration").read("observations").count() == 6 and Commit(spark, folder, "migration").read("analyses").count() == 4
    bad = spark.createDataFrame([(1, "{"), (2, "[]"), (3, json.dumps(event(event_id=" "))), (4, json.dumps(without(event(), "protocol"))), (5, json.dumps(event(techniques="x")))], "line_no long, value string")
    assert {r.line_no: r.error for r in contracts.migrated(bad).collect()} == {1: "malformed_json", 2: "record_not_object", 3: None, 4: "missing_fields", 5: "not_a_list"}
    with pytest.raises(contracts.ContractError, match="line 1: malformed_json; line 2: record_not_object; line 4: missing_fields; line 5: not_a_list"):
        contracts.migrate(spark, bad, None)

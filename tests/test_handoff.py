"""The batch handoff: preflight of files, finalising, staging, the exported bundle."""

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gridlark.operators import bundle, gates, handoff, report
from gridlark.sources.commits import Commit, Conflict

SECRET, SALT = "f" * 32, "s" * 32
TECHNIQUE = {"technique_id": "T0877", "name": "I/O Image", "tactic": "Collection", "confidence": "low", "rationale": "r"}


def record(k=0, **more):
    return {"event_id": f"e{k}", "session_id": f"s{k // 3}", "sensor_id": "x", "observed_at": f"2024-01-0{k % 8 + 1}T00:00:00+00:00", "protocol": ("modbus", "s7")[k % 2], "event_type": "protocol_request", "decoded": {"operation": "device_probe", "function_code": 3, "password": "x"}, "techniques": [TECHNIQUE], "tags": ["t"], "severity": "medium", "is_demo": True, "source_ip": f"192.0.2.{k % 5 + 1}", "raw_payload_hex": "00ff"} | more


def write(path, rows, end="\n"):
    path.write_bytes("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows).encode("utf-8", "surrogateescape") + end.encode())
    return f"file://{path}"


def reports(spark, path):
    lines, facts = handoff.read_numbered(spark, path)
    return {r.file.rpartition("/")[2]: r for r in handoff.preflight(gates.inspect_lines(lines), facts).collect()}


def test_preflight_of_files(spark, tmp_path):
    rows = [record(), record(), "", "\t", "{", "[1]", "null", record(2, protocol="dnp3"), record(3, is_demo=False, sanitized=True), record(4, observed_at="2023-05-05T01:00:00.5+02:00"), '{"a":"\udcff"}', record(5, event_type=7)]
    write(tmp_path / "a.jsonl", rows, end="")
    write(tmp_path / "b.jsonl", [record()])
    write(tmp_path / "blank.jsonl", [" ", ""])
    (tmp_path / "none.jsonl").write_bytes(b"")
    write(tmp_path / "many.jsonl", ["{"] * 150)
    got = reports(spark, f"file://{tmp_path}")
    a = got["a.jsonl"]
    assert (a.sha256, a.file_size_bytes) == (hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest(), (tmp_path / "a.jsonl").stat().st_size)
    assert (a.total_records, a.valid_records, a.invalid_records, a.duplicate_event_ids, a.valid) == (10, 3, 7, 1, False)
    assert json.loads(a.error_codes) == {"duplicate_event_id": 1, "incomplete_final_line": 1, "malformed_json": 2, "mixed_classification": 1, "mixed_privacy_state": 1, "private_fields_in_sanitized_record": 1, "missing_sanitized_source_id": 1, "record_not_object": 1, "unsupported_event_type": 1, "unsupported_protocol": 1}
    assert json.loads(a.protocols) == {"dnp3": 1, "modbus": 3, "s7": 2} and json.loads(a.event_types) == {"protocol_request": 5}
    assert (a.earliest_timestamp, a.latest_timestamp, a.data_classification, a.sanitized_input) == ("2023-05-04T23:00:00.500+00:00", "2024-01-06T00:00:00.000+00:00", "mixed", None)
    assert a.safe_errors[:3] == ["file does not end with a complete newline-terminated record", "record 2 failed: duplicate_event_id", "record 5 failed: malformed_json"] and a.safe_errors[-2:] == ["synthetic and observed records are mixed", "raw and sanitized records are mixed"]
    assert "record 12 failed: incomplete_final_line, unsupported_event_type" in a.safe_errors
    b = got["b.jsonl"]
    assert b.valid and (b.total_records, b.error_codes, b.safe_errors, b.data_classification, b.sanitized_input) == (1, "{}", [], "synthetic", False)
    for name in ("blank.jsonl", "none.jsonl"):
        assert (got[name].total_records, json.loads(got[name].error_codes), got[name].safe_errors, got[name].data_classification) == (0, {"empty_file": 1}, ["file contains no event records"], "unknown")
    assert got["none.jsonl"].sha256 == hashlib.sha256().hexdigest()
    assert len(got["many.jsonl"].safe_errors) == 100 and got["many.jsonl"].safe_errors[-1] == "record 100 failed: malformed_json" and got["many.jsonl"].invalid_records == 150


class Killed(Exception):
    pass


def killed_at(stage):
    def step(now):
        if now == stage:
            raise Killed(now)

    return step


def test_finalize_counts_whole_or_not_at_all(spark, tmp_path):
    source = write(tmp_path / "in.jsonl", [record(k) for k in range(20)] + [""])
    go = lambda **more: handoff.finalize(spark, source, f"file://{tmp_path}/out", fingerprint_secret=SECRET, privacy_salt=SALT, **more)
    plan = go(dry_run=True, approve_public=True)
    assert plan["dry_run"] and not (tmp_path / "out").exists() and "public_graph_candidate" in plan["stages"]
    for stage in ("sanitized", "exported"):
        with pytest.raises(Killed):
            go(approve_public=True, step=killed_at(stage))
    run = plan["input"]["sha256"][:16] + "-reviewed-candidates"
    assert Commit(spark, f"file://{tmp_path}/out", run).manifest() is None
    done = go(approve_public=True)
    assert done["input"]["record_count"] == 20 and done["publication_performed"] is False and done["input"]["sha256"] == hashlib.sha256((tmp_path / "in.jsonl").read_bytes()).hexdigest()
    assert set(done["outputs"]) == {"sanitized_candidate", "staged_lines", "observation_index", "private_weekly_report.md", "private_navigator_layer.json", "aggregate_summary_candidate.json", "public_graph_candidate"}
    again = go(approve_public=True)
    assert again.pop("rerun_status") == "already_complete_and_verified" and again == done
    private = go()
    assert "public_graph_candidate" not in private["outputs"] and private["outputs"]["observation_index"]["sha256"] == done["outputs"]["observation_index"]["sha256"]
    commit = Commit(spark, f"file://{tmp_path}/out", run)
    texts = [r.value for r in commit.read("sanitized_candidate").orderBy("seq").collect()]
    want = "src-" + hashlib.sha256(f"{SALT}|192.0.2.1".encode()).hexdigest()[:12]
    one = {k: v for k, v in record().items() if k not in ("source_ip", "raw_payload_hex")} | {"sanitized": True, "source_id": want, "decoded": {"function_code": 3, "operation": "device_probe"}}
    assert texts[0] == json.dumps(one, sort_keys=True, separators=(",", ":")) and len(texts) == 20
    assert b"192.0.2" not in commit.read("private_weekly_report.md") and json.loads(commit.read("aggregate_summary_candidate.json"))["protocols"] == {"modbus": 10, "s7": 10}
    assert json.loads(commit.read("private_navigator_layer.json"))["techniques"] == [{"techniqueID": "T0877", "score": 20, "comment": "20 observations; confidence: low=20", "enabled": True}]
    for part in (tmp_path / "out" / run / done["outputs"]["private_weekly_report.md"]["path"]).parent.glob("private_weekly_report.md"):
        part.write_text("other")
    with pytest.raises(Conflict):
        go(approve_public=True)
    with pytest.raises(ValueError, match="32"):
        handoff.finalize(spark, source, f"file://{tmp_path}/out", fingerprint_secret="x", privacy_salt=SALT)


def test_bad_files_are_refused(spark, tmp_path):
    bad = write(tmp_path / "bad.jsonl", [record(source_ip="192.0.2.77"), "{"])
    with pytest.raises(handoff.PreflightError, match="malformed_json") as e:
        handoff.finalize(spark, bad, f"file://{tmp_path}/out", fingerprint_secret=SECRET, privacy_salt=SALT)
    assert "192.0.2.77" not in str(e.value) and not (tmp_path / "out").exists()


def test_staging_appends_once(spark, tmp_path):
    clean = lambda k: {n: v for n, v in record(k).items() if n not in ("source_ip", "raw_payload_hex")} | {"sanitized": True, "source_id": f"src-{k}", "decoded": {"operation": "device_probe"}}
    one, two = write(tmp_path / "1.jsonl", [clean(k) for k in range(4)]), write(tmp_path / "2.jsonl", [clean(k) for k in range(4, 9)])
    folder = f"file://{tmp_path}/staging"
    with pytest.raises(ValueError, match="approval"):
        handoff.stage(spark, one, folder, approved=False)
    with pytest.raises(Killed):
        handoff.stage(spark, one, folder, approved=True, step=killed_at("written"))
    with pytest.raises(Conflict, match="interrupted"):
        handoff.stage(spark, two, folder, approved=True)
    first = handoff.stage(spark, one, folder, approved=True)
    assert first["already_staged"] is False and first["record_count"] == 4
    assert handoff.stage(spark, one, folder, approved=True) == first | {"already_staged": True}
    assert handoff.stage(spark, two, folder, approved=True)["record_count"] == 5
    assert handoff.Ledger(spark, folder).read().count() == 9 and len(list((tmp_path / "staging").glob("manifest-*.json"))) == 2
    with pytest.raises(Exception, match="sanitized flag is not true"):
        handoff.stage(spark, write(tmp_path / "3.jsonl", [record()]), folder, approved=True)


def test_bundle(spark):
    rows = [record(k, source_port=4000, destination_port=502) for k in range(6)] + [record(6, session_id=None, techniques=[TECHNIQUE | {"technique_id": "T9999"}], raw_payload_hex="", source_ip="2001:db8::1")]
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "line_no long, value string")
    events = handoff.events_of(lines).withColumn("source_id", F.concat(F.lit("SRC-"), F.substring_index("source_ip", ".", -1)))
    public, private = ([json.loads(r.value) | {"number": r.number} for r in bundle.bundle_objects(events, p).orderBy("number").collect()] for p in ("public", "private"))
    for objects in (public, private):
        assert [o["number"] for o in objects] == list(range(len(objects))) and [(o["type"], o["id"]) for o in objects] == sorted({(o["type"], o["id"]) for o in objects})
        ids = {o["id"] for o in objects}
        refs = {r for o in objects for k, v in o.items() if k.endswith("_ref") or k.endswith("_refs") for r in (v if isinstance(v, list) else [v])}
        assert refs <= ids
    kinds = lambda objects: {t: sum(o["type"] == t for o in objects) for t in {o["type"] for o in objects}}
    assert kinds(public) == {"identity": 1, "domain-name": 6, "network-traffic": 6, "observed-data": 7, "attack-pattern": 1, "relationship": 6, "grouping": 7}
    assert kinds(private) == {"identity": 1, "ipv4-addr": 5, "ipv6-addr": 1, "artifact": 1, "network-traffic": 6, "observed-data": 7, "attack-pattern": 2, "relationship": 7, "grouping": 7}
    artifact = next(o for o in private if o["type"] == "artifact")
    assert (artifact["payload_bin"], artifact["hashes"]["SHA-256"]) == ("AP8=", hashlib.sha256(b"\x00\xff").hexdigest())
    text = json.dumps(public)
    assert "192.0.2" not in text and "password" not in text and "payload" not in text and "T9999" not in text
    pattern = next(o for o in public if o["type"] == "attack-pattern")
    assert pattern["external_references"][0]["url"].endswith("/T0877/") and pattern["kill_chain_phases"][0]["phase_name"] == "collection"
    group = [o for o in public if o["type"] == "grouping"]
    assert all(o["created"] <= o["modified"] and o["created"].endswith("Z") for o in group) and {r for o in group for r in o["object_refs"]} >= {o["id"] for o in public if o["type"] in ("observed-data", "relationship")}
    objects = bundle.bundle_objects(events)
    assert bundle.bundle_id(objects) == bundle.bundle_id(objects.repartition(3)) != bundle.bundle_id(objects.where("number > 0"))
    with pytest.raises(Exception, match="no source"):
        bundle.bundle_objects(events.withColumn("source_id", F.lit(" "))).count()
    with pytest.raises(Exception, match="no valid time"):
        bundle.bundle_objects(events.withColumn("observed_at", F.lit("yesterday"))).collect()


def test_report_texts(spark):
    schema = "last_seen long, repeat_count long, session_id string, source_id string, protocol string, is_demo boolean, techniques array<struct<technique_id:string,confidence:string>>"
    end = datetime(2024, 1, 8, tzinfo=UTC)
    at = int(end.timestamp())
    rows = [(at - 1, 3, "a", "s1", "modbus", False, [("T0877", "low")]), (at - 5, 2, "b", "s1", "dnp3", False, [("T0877", "high"), ("T0843", "high")]), (at, 9, "c", "s2", "s7", False, []), (at - 8 * 86400, 9, "d", "s2", "s7", False, []), (at - 2, 1, "", "s3", "s7", False, None)]
    text = report.weekly_text(spark.createDataFrame(rows, schema), end)
    for line in ("- Sessions: 2", "- Events with repeats: 6", "| modbus | 3 |", "| s7 | 1 |", "| iec104 | 0 |", "| dnp3 | 2 |", "| T0877 | 5 | high: 2, low: 3 |", "| T0843 | 2 | high: 2 |", "| s1 | 2 |", "Window: 2024-01-01T00:00:00+00:00 to 2024-01-08T00:00:00+00:00 (UTC), end excluded."):
        assert line in text.splitlines()
    assert "s3" not in text and "private sanitised" in text
    empty = report.weekly_text(spark.createDataFrame([], schema), end)
    assert "| None | 0 | nothing was mapped in the window |" in empty and "| None | 0 |" in empty
    with pytest.raises(ValueError, match="mixed"):
        report.weekly_text(spark.createDataFrame(rows + [(at - 1, 1, "z", "s", "s7", True, [])], schema), end)
    with pytest.raises(ValueError, match="T9999"):
        report.layer(spark.createDataFrame([(at, 1, "a", "s", "s7", True, [("T9999", "low")])], schema))

"""Index, gates, rules, sources and streams on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridlark.operators import detection, gates, index
from gridlark.plans.detection import PACK
from gridlark.sources import foreign, jsonl, profiles
from gridlark.sources.rules import read_pack, read_selections
from gridlark.streaming import state


def test_merge_window_is_inclusive(spark):
    t = spark.createDataFrame([(1, 1000), (2, 2799), (3, 4600)], "seq long, observed_epoch long").withColumns({"fingerprint": F.lit("f"), "event_id": F.concat(F.lit("e"), "seq")})
    got = index.merged_observations(t, 1800).orderBy("first_seq").collect()
    assert [(r.first_seen, r.last_seen, r.repeat_count, r.event_id) for r in got] == [(1000, 2799, 2, "e1"), (4600, 4600, 1, "e3")]


def test_import_fails_on_changed_content(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "event_id string, digest string")
    assert {r.event_id for r in index.import_batch(new, spark.createDataFrame([("a", "1")], new.schema)).collect()} == {"b"}
    with pytest.raises(Exception, match="other content"):
        index.import_batch(new, spark.createDataFrame([("a", "9")], new.schema)).collect()


def good_record(**more):
    return {"event_id": "e1", "session_id": "s", "sensor_id": "x", "observed_at": "2024-01-01T00:00:00+00:00", "protocol": "modbus", "event_type": "connection", "decoded": {}, "techniques": [], "tags": [], "severity": "info", "is_demo": True, "source_ip": "192.0.2.1"} | more


def test_preflight_codes(spark):
    lines = [json.dumps(good_record()), json.dumps(good_record()), "{", "[1]", "", json.dumps(good_record(event_id="e2", extra=1)), json.dumps(good_record(event_id="e3", raw_payload_hex="0" * 2000)), "x" * 70_000]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.line_no: r.codes for r in gates.inspect_lines(df).collect()}
    assert got == {0: [], 1: ["duplicate_event_id"], 2: ["malformed_json"], 3: ["record_not_object"], 5: ["unexpected_top_level_fields"], 6: ["invalid_raw_payload"], 7: ["oversized_record"]}


def test_rule_pack_on_labelled_cases(spark):
    schema = "event_id string, sensor_id string, event_type string, protocol string, operation string, function_code int, signature string, expected_sigma array<string>, expected_wazuh array<string>, expected_suricata array<string>"
    cases = [
        ("write", "s", "protocol_request", "modbus", "write_single", 6, None, ["gl_modbus_write"], ["110101"], ["4210501"]),
        ("unassigned", "s", "protocol_request", "modbus", "unknown", 90, None, [], [], ["4210503"]),
        ("identify", "s", "protocol_request", "modbus", "device_probe", 43, None, [], [], ["4210504"]),
        ("command", "s", "protocol_request", "iec104", "setpoint_command", None, None, ["gl_iec104_command"], ["110102"], []),
        ("download", "s", "protocol_request", "s7", "program_download", None, None, ["gl_s7_program_download"], ["110103"], []),
        ("exploit", "s", "known_exploit_probe", "s7", "device_probe", None, "sig", ["gl_exploit_probe"], ["110104"], []),
        ("connection", "s", "connection", "modbus", None, 3, None, [], [], []),
        ("no evidence", "s", "known_exploit_probe", "s7", "device_probe", None, None, [], [], []),
        ("no sensor", None, "protocol_request", "modbus", "write_multiple", 16, None, ["gl_modbus_write"], [], ["4210501"]),
    ]
    assert detection.pack_errors(spark.createDataFrame(cases, schema), read_pack(PACK)).collect() == []


def test_rule_reader_rejects_what_it_cannot_match():
    with pytest.raises(ValueError):
        read_selections("title: x\nid: 3c7d2f0e-58b1-4f0a-9a54-0d5f6f0a1001\nlevel: low\ndetection:\n  selection:\n    a|contains: b\n")


def test_replay_and_suppression(spark):
    assert state.suppression_fold([0, 599, 600, 1199, 1200], None, 600) == ([True, False, True, False, True], 1200)
    t = spark.createDataFrame([("k", n, e) for n, e in enumerate((0, 599, 600, 1300))] + [("j", 9, 5)], "alert_key string, seq long, epoch long")
    got = {(r.alert_key, r.epoch): r.sent for r in state.suppressed_alerts(t).collect()}
    assert got == {("k", 0): True, ("k", 599): False, ("k", 600): True, ("k", 1300): True, ("j", 5): True}


def test_registers_keep_order(spark):
    t = spark.createDataFrame([("s", 2, 1, 20), ("s", 1, 1, 10), ("s", 3, 500, 1)], "sensor_id string, seq long, address int, value int")
    got = [(r.seq, r.previous, r.applied) for r in state.register_updates(t).orderBy("seq").collect()]
    assert got == [(1, 0, True), (2, 10, True), (3, 0, False)]


def test_foreign_logs_and_sanitising(spark):
    rows = [json.dumps({"remote": ["203.0.113.9", 4000], "protocol": "Modbus", "request": {"operation": "write_single", "function_code": 6}}), json.dumps({"remote": "203.0.113.9:77", "data_type": "s7"}), json.dumps({"remote": "2001:db8::1", "decoded": "text"})]
    e = foreign.normalise_foreign(spark.createDataFrame([(r,) for r in rows], "value string"), "s1").collect()
    assert [(r.source_ip, r.source_port, r.event_type, r.severity) for r in e] == [("203.0.113.9", 4000, "protocol_request", "high"), ("203.0.113.9", 77, "connection", "info"), ("2001:db8::1", 0, "protocol_request", "info")]
    one = spark.createDataFrame([("192.0.2.1", "aa", '{"a":{"api_token":1,"b":[{"password":2,"c":3}]}}')], "source_ip string, raw_payload_hex string, decoded_json string")
    got = foreign.sanitise(one, "s" * 32).first()
    assert got.asDict().keys() == {"source_id", "sanitized", "decoded_json"} and got.decoded_json == '{"a":{"b":[{"c":3}]}}'
    assert [r[0] for r in spark.createDataFrame([("192.0.2.7",), ("2001:db8:1:2::3",), ("x",)], "a string").select(foreign.network_of("a")).collect()] == ["192.0.2.0/24", "2001:db8:1::/48", None]


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps(good_record(decoded={"operation": "write_single", "function_code": 6})) + "\n\n")
    e = jsonl.read_events(spark, f"file://{tmp_path}/in.jsonl")
    assert e.first().decoded.function_code == 6
    jsonl.write_events(e.drop("raw"), f"file://{tmp_path}/out")
    assert jsonl.read_events(spark, f"file://{tmp_path}/out").count() == 1
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="line 1 of bad.jsonl is not a JSON object"):
        jsonl.read_events(spark, f"file://{tmp_path}/bad.jsonl").collect()
    got = spark.createDataFrame([('{"b": 1.0, "a": "\\u00e9"}',), ("{",)], "v string").select(jsonl.canonical_text("v")).collect()
    assert [r[0] for r in got] == ['{"a":"\\u00e9","b":1.0}', None]
    assert jsonl.write_once(str(tmp_path / "f"), b"1") == jsonl.write_once(str(tmp_path / "f"), b"1")
    with pytest.raises(FileExistsError):
        jsonl.write_once(str(tmp_path / "f"), b"2")


def test_profiles():
    good = {"schema_version": 1, "fictional": True, "profile_id": "pump-1", "display_name": "Pump", "sector": "water", "description": "d", "device": {"vendor": "none"}, "modbus": {"holding_registers": {"1": 5}, "writable_ranges": [[0, 9]]}}
    p = profiles.load_profile(json.dumps(good))
    assert (p.registers, p.writable, p.device, p.texts["sector"]) == ({1: 5}, [(0, 9)], {"vendor": "none"}, "water")
    bad = [
        {"fictional": False}, {"schema_version": 2}, {"profile_id": "P"}, {"other": 1}, {"s7": {"x": [{"Sub-Process": 1}, {"shell": 2}]}}, {"display_name": " "}, {"sector": "x" * 41}, {"description": "a\nb"}, {"device": {str(k): "x" for k in range(17)}},
        {"modbus": {"holding_registers": {"70000": 1}}}, {"modbus": {"writable_ranges": [[9, 0]]}}, {"modbus": {"writable_ranges": [[1]]}}, {"modbus": []}, {"modbus": {"holding_registers": {"1": "x"}}},
    ]
    for change in bad:
        with pytest.raises(ValueError):
            profiles.load_profile(json.dumps(good | change))
    with pytest.raises(ValueError, match="profile.s7.x\\[1\\].shell"):
        profiles.load_profile(json.dumps(good | {"s7": {"x": [1, {"shell": 2}]}}))


def test_foreign_fields_that_are_missing(spark):
    rows = ["{}", '{"remote":"","src_ip":"203.0.113.1","src_port":9,"request":[],"timestamp":"t"}', '{"remote":[],"observed_at":"t","decoded":"' + "x" * 300 + '"}']
    e = foreign.normalise_foreign(spark.createDataFrame([(r,) for r in rows], "value string"), "s1").collect()
    assert [(r.source_ip, r.source_port, r.event_type, r.tags) for r in e] == [("0.0.0.0", 0, "connection", ["conpot"]), ("203.0.113.1", 9, "connection", ["conpot"]), ("0.0.0.0", 0, "protocol_request", ["conpot"])]
    assert e[1].session_id == hashlib.sha256(b"s1|203.0.113.1|9|t").hexdigest()[:16] and e[0].observed_at.endswith("+00:00") and len(e[2].message) == 256


def test_arc_of_a_point_at_home(spark):
    from gridlark.operators import geometry

    p = spark.createDataFrame([("a", "b", "c", *geometry.HOME), ("d", "b", "c", 10.0, 20.0), ("n", "b", "c", None, 2.0)], "source string, country string, protocol string, latitude double, longitude double")
    got = {}
    for r in geometry.great_circles(p).orderBy("step").collect():
        got.setdefault(r.source, []).append((r.latitude, r.longitude))
    assert got["a"] == [geometry.HOME, geometry.HOME] and len(got["d"]) == 28 and got["d"][0] == (10.0, 20.0) and got["d"][-1] == geometry.HOME and "n" not in got


def test_registers_carry_over_blocks_without_groups_in_memory(spark):
    rng = __import__("random").Random(6)
    rows = [("hot" if rng.random() < 0.8 else f"s{k % 3}", 7 * k, rng.choice((3, 3, 3, 5, 99, 100, -1)), rng.choice((1, 2, 70_000, -4, 900)) if k % 5 else k) for k in range(3000)]
    held, want = {}, []
    for sensor, seq, address, value in rows:
        ok = 0 <= address <= 99 and 0 <= value <= 0xFFFF
        want.append((sensor, seq, address, held.get((sensor, address), 0), value, ok))
        if ok:
            held[sensor, address] = value
    # registers with a gap of whole blocks, and a block without an applied write
    rows += [("gap", 0, 1, 5), ("gap", 30_000, 1, -1), ("gap", 90_000, 1, 6), ("gap", 90_001, 1, 7)]
    want += [("gap", 0, 1, 0, 5, True), ("gap", 30_000, 1, 5, -1, False), ("gap", 90_000, 1, 5, 6, True), ("gap", 90_001, 1, 6, 7, True)]
    got = state.register_updates(spark.createDataFrame(rows, "sensor_id string, seq long, address int, value int").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.dtypes == [("sensor_id", "string"), ("seq", "bigint"), ("address", "int"), ("previous", "int"), ("value", "int"), ("applied", "boolean")]
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_late_observations_join_only_rows_not_beyond_them(spark):
    from gridlark.operators import index

    rows = [("a", 1, 5000), ("a", 2, 1000), ("a", 3, 5100), ("b", 4, 0), ("b", 5, 1800), ("b", 6, 9000), ("b", 7, 1700), ("b", 8, 9000), ("c", 9, 50)]
    t = spark.createDataFrame([(k, s, f"e{s}", e) for k, s, e in rows], "fingerprint string, seq long, event_id string, observed_epoch long")
    got = sorted((r.fingerprint, r.first_seen, r.last_seen, r.repeat_count, r.event_id) for r in index.merged_observations(t, 1800).collect())
    assert got == [("a", 1000, 1000, 1, "e2"), ("a", 5000, 5100, 2, "e1"), ("b", 0, 1800, 2, "e4"), ("b", 1700, 1700, 1, "e7"), ("b", 9000, 9000, 2, "e6"), ("c", 50, 50, 1, "e9")]
    assert index.merged_observations(t.limit(0), 1800).count() == 0


def test_health_rules_on_missing_times(spark):
    from gridlark.operators import gates

    schema = "snapshot_id string, process_running boolean, status string, generated_epoch long, last_event_epoch long, expect_traffic boolean, disk_free_percent double, alert_queue_drops long, collector_queue_drops long, spool_queue_drops long, delivery_failures long, rejected_sessions long, storage_ready boolean"
    rows = [("ok", True, "ok", 1000, 1000, True, 50.0, 0, 0, 0, 0, 0, True), ("none", True, "ok", None, None, True, 9.5, None, None, 1, None, None, None), ("down", None, None, 1000, None, False, 4.9, 0, 0, 0, 2, 1, False)]
    got = {r.snapshot_id: (r.status, r.findings) for r in gates.health_findings(spark.createDataFrame(rows, schema), F.lit(1010)).collect()}
    assert got == {
        "ok": ("ok", ""),
        "none": ("critical", "snapshot_freshness=critical, event_freshness=warning, disk=warning, queue_drops=warning, collector_storage=warning"),
        "down": ("critical", "process=critical, disk=critical, delivery=warning, session_capacity=warning, collector_storage=critical"),
    }


def test_public_gate_on_mixed_classes(spark):
    from gridlark.operators import gates

    lines = [(1, '{"source_id":"s","is_demo":true,"sanitized":true}'), (2, '{"source_id":"s","is_demo":false,"sanitized":true}'), (3, "  ")]
    t = spark.createDataFrame(lines, "line_no long, value string")
    assert tuple(gates.public_report(t).first()) == (2, 0, True, False, False)
    assert tuple(gates.public_report(t.where("line_no = 1")).first()) == (1, 0, False, False, True)
    assert tuple(gates.public_report(t.limit(0)).first()) == (0, 0, False, True, False)


def test_line_numbers_of_split_files(spark, tmp_path):
    """Files are read in many splits; numbers are those of an editor."""
    from gridlark.sources import jsonl

    texts = {"a": [f"line {k} " + "x" * (k % 90) for k in range(1, 4001)], "b": ["", "é", ""], "c": []}
    for name, lines in texts.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    (tmp_path / "d.txt").write_text("no end", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = jsonl.read_lines(spark, str(tmp_path))
        assert read.select("file").distinct().count() == 3
        got = sorted((r.file[-5], r.line_no, r.value) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(name, k, x) for name, lines in texts.items() for k, x in enumerate(lines, 1)] + [("d", 1, "no end")]
    assert got == sorted(want)
    facts = {r.file[-5]: (r.size, r.ends_with_newline, r.newlines, r.sha256) for r in jsonl.file_facts(spark, str(tmp_path), 1000).collect()}
    assert facts["b"][:3] == (5, True, 3) and facts["d"][:3] == (6, False, 0) and facts["c"][:3] == (0, False, 0) and facts["a"][2] == 4000
    assert all(f[3] == hashlib.sha256((tmp_path / f"{name}.txt").read_bytes()).hexdigest() for name, f in facts.items())

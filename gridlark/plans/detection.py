"""Queries of the detection rules."""

from __future__ import annotations

from pathlib import Path

from gridlark.operators import detection
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, telemetry
from gridlark.sources.rules import read_pack

T = TELEMETRY_SQL
PACK = str(Path(__file__).resolve().parents[1] / "rules")
#: Behaviours (protocol, operation) that the rule pack's fixtures exercise.
FIXTURES = [("modbus", "write_single"), ("modbus", "write_multiple"), ("modbus", "device_probe"), ("iec104", "setpoint_command"), ("s7", "program_download"), ("s7", "device_probe"), ("s7", "connection_setup")]

_SIGMA = [
    ("gl_modbus_write", "Modbus write command", "high", "T1692.001, T0836", "event_type = 'protocol_request' AND protocol = 'modbus' AND operation IN ('write_single', 'write_multiple')"),
    ("gl_iec104_command", "IEC 104 control command", "high", "T1692.001, T0836", "event_type = 'protocol_request' AND protocol = 'iec104' AND operation IN ('single_command', 'setpoint_command')"),
    ("gl_s7_program_download", "S7 program download", "high", "T0843", "event_type = 'protocol_request' AND protocol = 's7' AND operation = 'program_download'"),
    ("gl_exploit_probe", "Exploit probe with a named signature", "critical", "T0866", "event_type = 'known_exploit_probe' AND signature IS NOT NULL"),
]
_WAZUH = [
    ("110101", "Modbus write against a decoy.", "high", "T1692.001, T0836", "event_type = 'protocol_request' AND protocol = 'modbus' AND regexp_matches(operation, '^write_(single|multiple)$')"),
    ("110102", "IEC 104 control command against a decoy.", "high", "T1692.001, T0836", "event_type = 'protocol_request' AND protocol = 'iec104' AND regexp_matches(operation, '^(single|setpoint)_command$')"),
    ("110103", "S7 program download.", "high", "T0843", "event_type = 'protocol_request' AND protocol = 's7' AND operation = 'program_download'"),
    ("110104", "Exploit probe with a named signature.", "high", "T0866", "event_type = 'known_exploit_probe' AND signature IS NOT NULL"),
]
_SURICATA = [
    ("4210501", "Modbus write", "high", "T1692.001", "protocol = 'modbus' AND starts_with(operation, 'write_')"),
    ("4210503", "Modbus unassigned function", "medium", "T0846.001", "protocol = 'modbus' AND function_code > 64"),
    ("4210504", "Modbus encapsulated interface", "medium", "T0846.001", "protocol = 'modbus' AND function_code = 43"),
]


def _sql(engine: str, rules) -> str:
    return " UNION ALL ".join(
        f"SELECT event_id, protocol, 'Rule conditions matched event_type=' || event_type || ', protocol=' || protocol || ', operation=' || operation || '.' AS reason, '{engine}' AS engine, '{i}' AS rule_id, '{t}' AS title, '{s}' AS severity, '{q}' AS technique FROM tel WHERE {p}" for i, t, s, q, p in rules
    )


ALL = " UNION ALL ".join(_sql(e, r) for e, r in (("Sigma", _SIGMA), ("Wazuh", _WAZUH), ("Suricata", _SURICATA)))


def _found(spark, sf_dir, *engines):
    return detection.predictions(telemetry(spark, sf_dir), read_pack(PACK), engines or ("Sigma", "Wazuh", "Suricata"))


@query("sigma_matches", T + _sql("Sigma", _SIGMA))
def sigma_matches(spark, sf_dir):
    return _found(spark, sf_dir, "Sigma")


@query("wazuh_matches", T + _sql("Wazuh", _WAZUH))
def wazuh_matches(spark, sf_dir):
    return _found(spark, sf_dir, "Wazuh")


@query("suricata_matches", T + _sql("Suricata", _SURICATA))
def suricata_matches(spark, sf_dir):
    return _found(spark, sf_dir, "Suricata")


@query("detection_preview", T + ALL)
def detection_preview(spark, sf_dir):
    return _found(spark, sf_dir)


@query("detection_coverage", T + f"SELECT protocol, count(*) AS predictions, count(DISTINCT rule_id) AS rules, count(DISTINCT technique) AS techniques FROM ({ALL}) GROUP BY protocol")
def detection_coverage(spark, sf_dir):
    return detection.coverage(_found(spark, sf_dir))


@query("uncovered_techniques", T + f"SELECT DISTINCT unnest(technique_ids) AS technique FROM tel EXCEPT SELECT technique FROM ({ALL})")
def uncovered_techniques(spark, sf_dir):
    return detection.uncovered_techniques(telemetry(spark, sf_dir), _found(spark, sf_dir))


_FIX = ", ".join(f"'{p}|{o}'" for p, o in FIXTURES)


@query(
    "coverage_backlog",
    T + f", p AS ({ALL}), pe AS (SELECT event_id, list(DISTINCT engine) AS engines FROM p GROUP BY 1), b AS (SELECT protocol, operation, count(*) AS observed_events, list_sort(list_distinct(flatten(list(technique_ids)))) AS t, list_sort(list_distinct(flatten(list(coalesce(engines, []))))) AS e FROM tel LEFT JOIN pe USING (event_id) GROUP BY 1, 2) SELECT protocol, operation, observed_events, CASE WHEN len(t) > 0 THEN array_to_string(t, ', ') ELSE 'not mapped' END AS mapped_techniques, CASE WHEN len(e) > 0 THEN array_to_string(e, ', ') ELSE 'none' END AS rule_engines, CASE WHEN protocol || '|' || operation IN ({_FIX}) THEN 'synthetic fixture present' ELSE 'no matching fixture' END AS fixture_coverage, CASE WHEN len(t) = 0 THEN 'mapping review' WHEN len(e) = 0 THEN 'rule opportunity' WHEN protocol || '|' || operation NOT IN ({_FIX}) THEN 'fixture follow-up' ELSE 'covered in pack' END AS status FROM b",
)
def coverage_backlog(spark, sf_dir):
    return detection.coverage_backlog(telemetry(spark, sf_dir), _found(spark, sf_dir), FIXTURES)

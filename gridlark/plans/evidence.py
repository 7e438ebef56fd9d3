"""Queries of per-event enrichment, decoding and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import crypto, decode, enrich
from gridlark.operators import evaluation
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, raw_telemetry, telemetry

T = TELEMETRY_SQL


@query("map_techniques", T + "SELECT event_id, array_to_string(technique_ids, ',') AS techniques FROM tel")
def map_techniques(spark, sf_dir):
    t = raw_telemetry(spark, sf_dir)
    found = enrich.map_techniques(*map(F.col, ("protocol", "event_type", "operation", "function_code", "signature")))
    return t.select("event_id", F.array_join(enrich.technique_ids(found), ",").alias("techniques"))


@query("severity", T + "SELECT event_id, severity FROM tel")
def severity(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", enrich.severity(F.col("techniques")).alias("severity"))


@query("triage_score", T + "SELECT event_id, triage_score, priority FROM tel")
def triage_score(spark, sf_dir):
    """The general form: factors from technique arrays, then their sum."""
    t = telemetry(spark, sf_dir).select("event_id", enrich.score(F.col("factors")).alias("triage_score"))
    return t.select("event_id", "triage_score", enrich.priority(F.col("triage_score")).alias("priority"))


@query("triage_factors", T + "SELECT event_id, factors FROM tel")
def triage_factors(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", enrich.factor_summary(F.col("factors")).alias("factors"))


@query("evidence_completeness", T + "SELECT event_id, CAST(checks_met AS int) AS checks_met, CASE WHEN checks_met = 4 THEN 'complete fields' WHEN checks_met <= 1 THEN 'limited fields' ELSE 'partial fields' END AS label, array_to_string(list_filter([CASE WHEN source_country IS NULL OR source_latitude IS NULL OR source_longitude IS NULL THEN 'coarse public location' END, CASE WHEN len(technique_ids) = 0 THEN 'evidence-qualified mapping' END], lambda x: x IS NOT NULL), ', ') AS missing FROM tel")
def evidence_completeness(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", F.col("completeness.met").alias("checks_met"), "completeness.label", F.array_join("completeness.missing", ", ").alias("missing"))


@query("mapping_confidence", T + "SELECT event_id, confidence AS mapping_confidence FROM tel")
def mapping_confidence(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", enrich.view_confidence(F.col("techniques")).alias("mapping_confidence"))


@query("pseudonymize", T + "SELECT event_id, source_id FROM raw")
def pseudonymize(spark, sf_dir):
    return raw_telemetry(spark, sf_dir).select("event_id", crypto.pseudonym(F.col("source_ip"), crypto.SYNTHETIC_SALT).alias("source_id"))


@query("network_prefix", T + "SELECT event_id, '192.0.2.0/24' AS source_network FROM raw")
def network_prefix(spark, sf_dir):
    return raw_telemetry(spark, sf_dir).select("event_id", crypto.network_prefix(F.col("source_ip")).alias("source_network"))


@query("session_key", T + "SELECT event_id, substr(sha256(sensor_id || '|' || source_ip || '|' || (40000 + seq % 20000) || '|' || observed_epoch), 1, 16) AS session_key FROM raw")
def session_key(spark, sf_dir):
    port = (40000 + F.col("seq") % 20000).cast("string")
    return raw_telemetry(spark, sf_dir).select("event_id", crypto.session_key(F.col("sensor_id"), F.col("source_ip"), port, F.col("observed_epoch").cast("string")).alias("session_key"))


NAMESPACE = "f203c17f-eb79-5e94-9db5-ef8739117371"


def uuid5_sql(namespace: str, name: str) -> str:
    d = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || substr('89ab', (('0x' || substr({d}, 17, 1))::int % 4) + 1, 1) || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


@query("uuid5_ids", T + f"SELECT event_id, {uuid5_sql(NAMESPACE, 'event_id')} AS object_id FROM raw")
def uuid5_ids(spark, sf_dir):
    return raw_telemetry(spark, sf_dir).select("event_id", crypto.uuid5(NAMESPACE, F.col("event_id")).alias("object_id"))


def _hex(value, width):
    return F.lpad(F.lower(F.hex(value)), width, "0")


@query(
    "decode_modbus",
    T + "SELECT event_id, k % 17 <> 0 AND k % 13 <> 0 AS valid, CASE WHEN k % 17 = 0 THEN 'device_probe' ELSE operation END AS operation, CASE WHEN k % 17 = 0 THEN 'truncated_mbap' END AS error, CASE WHEN k % 17 <> 0 THEN seq % 65536 END::int AS transaction_id, CASE WHEN k % 17 <> 0 THEN k % 5 END::int AS unit_id, CASE WHEN k % 17 <> 0 THEN function_code END::int AS function_code, CASE WHEN k % 17 <> 0 THEN k * 3 END::int AS address, CASE WHEN k % 17 <> 0 THEN 2 END::int AS value_or_quantity, CASE WHEN k % 17 <> 0 AND function_code = 16 THEN k || ',' || (k + 256) END AS write_values FROM raw WHERE protocol = 'modbus'",
)
def decode_modbus(spark, sf_dir):
    """Requests built from the telemetry: some truncated (k % 17), some of another protocol id (k % 13), two registers written."""
    t = raw_telemetry(spark, sf_dir).where("protocol = 'modbus'")
    k = F.col("k")
    whole = F.concat(
        _hex(F.col("seq") % 65536, 4), F.when(k % 13 == 0, "0001").otherwise("0000"), F.lit("000b"), _hex(k % 5, 2), _hex(F.col("function_code"), 2), _hex(k * 3, 4), F.lit("0002"), F.lit("04"), _hex(k, 4), _hex(k + 256, 4)
    )
    d = decode.modbus(F.unhex(F.when(k % 17 == 0, "0001").otherwise(whole)))
    one = t.select("event_id", d.alias("d"))
    return one.select("event_id", "d.valid", "d.operation", "d.error", "d.transaction_id", "d.unit_id", "d.function_code", "d.address", "d.value_or_quantity", F.array_join(F.transform("d.write_values", lambda v: v.cast("string")), ",").alias("write_values"))


@query(
    "decode_s7",
    T + "SELECT event_id, k % 7 <> 0 AS valid, CASE WHEN k % 7 = 0 THEN 'connection_setup' WHEN k % 5 = 0 AND k % 11 <> 0 THEN 'program_download' ELSE 'connection_setup' END AS operation, CASE WHEN k % 7 = 0 THEN 'not_tpkt' END AS error, CASE WHEN k % 7 <> 0 THEN 22 END::int AS tpkt_length, CASE WHEN k % 7 <> 0 THEN '0xf0' END AS cotp_pdu_type, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN CASE WHEN k % 5 = 0 THEN 26 ELSE 4 END END::int AS s7_function FROM raw WHERE protocol = 's7'",
)
def decode_s7(spark, sf_dir):
    """Requests with a program transfer (k % 5), of another version (k % 7), cut before the function (k % 11)."""
    t = raw_telemetry(spark, sf_dir).where("protocol = 's7'")
    k = F.col("k")
    payload = F.concat(F.when(k % 7 == 0, "04").otherwise("03"), F.lit("00001602f080"), F.lit("32010000000000080000"), F.when(k % 11 == 0, "").when(k % 5 == 0, "1a").otherwise("04"))
    d = decode.s7(F.unhex(payload))
    return t.select("event_id", d.alias("d")).select("event_id", "d.valid", "d.operation", "d.error", "d.tpkt_length", "d.cotp_pdu_type", "d.s7_function")


@query(
    "decode_iec104",
    T + ", f AS (SELECT *, k % 4 AS c FROM raw WHERE protocol = 'iec104') SELECT event_id, k % 9 <> 0 AS valid, CASE WHEN k % 9 = 0 THEN 'interrogation' WHEN c IN (0, 2) THEN CASE WHEN 40 + k % 30 IN (45, 46, 47, 58, 59, 60) THEN 'single_command' WHEN 40 + k % 30 BETWEEN 45 AND 51 OR 40 + k % 30 BETWEEN 58 AND 64 THEN 'setpoint_command' ELSE 'interrogation' END WHEN c = 1 THEN 'interrogation' ELSE 'connection_setup' END AS operation, CASE WHEN k % 9 = 0 THEN 'not_iec104_apdu' END AS error, CASE WHEN k % 9 <> 0 THEN CASE WHEN c IN (0, 2) THEN 'I' WHEN c = 1 THEN 'S' ELSE 'U' END END AS frame_type, CASE WHEN k % 9 <> 0 AND c IN (0, 2) THEN 40 + k % 30 END::int AS type_id, CASE WHEN k % 9 <> 0 AND c = 3 THEN '0x3' END AS u_function FROM f",
)
def decode_iec104(spark, sf_dir):
    """Frames by k: I, S and U by the control byte k % 4, other protocols at k % 9."""
    t = raw_telemetry(spark, sf_dir).where("protocol = 'iec104'")
    k = F.col("k")
    payload = F.concat(F.when(k % 9 == 0, "67").otherwise("68"), F.lit("0e"), _hex(k % 4, 2), F.lit("000000"), _hex(40 + k % 30, 2))
    d = decode.iec104(F.unhex(payload))
    return t.select("event_id", d.alias("d")).select("event_id", "d.valid", "d.operation", "d.error", "d.frame_type", "d.type_id", "d.u_function")


def _cases(spark, sf_dir):
    """Predicted labels against expected ones that miss T0877 at k % 7 and add T0866 at k % 11."""
    t = telemetry(spark, sf_dir).select("k", F.col("technique_ids").alias("predicted"))
    want = F.when(F.col("k") % 7 == 0, F.array_remove("predicted", "T0877")).otherwise(F.col("predicted"))
    return t.select("predicted", F.when(F.col("k") % 11 == 0, F.array_union(want, F.array(F.lit("T0866")))).otherwise(want).alias("expected"))


_CASES = ", c0 AS (SELECT k, technique_ids AS predicted, CASE WHEN k % 7 = 0 THEN list_filter(technique_ids, lambda x: x <> 'T0877') ELSE technique_ids END AS w FROM tel), c AS (SELECT predicted, CASE WHEN k % 11 = 0 AND NOT list_contains(w, 'T0866') THEN list_append(w, 'T0866') ELSE w END AS expected FROM c0), u AS (SELECT predicted, expected, unnest(list_distinct(list_concat(predicted, expected))) AS label FROM c), b AS (SELECT label, count(*) FILTER (list_contains(predicted, label) AND list_contains(expected, label)) AS tp, count(*) FILTER (list_contains(predicted, label) AND NOT list_contains(expected, label)) AS fp, count(*) FILTER (NOT list_contains(predicted, label) AND list_contains(expected, label)) AS fn FROM u GROUP BY label), q AS (SELECT *, (SELECT count(*) FROM c) - tp - fp - fn AS tn, coalesce(tp::double / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::double / nullif(tp + fn, 0), 0) AS recall FROM b), m AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, tp + fn AS support FROM q)"


@query("mapper_evaluation", T + _CASES + " SELECT label, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def mapper_evaluation(spark, sf_dir):
    m = evaluation.label_metrics(_cases(spark, sf_dir))
    return m.select("label", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("mapper_evaluation_summary", T + _CASES + ", s AS (SELECT sum(tp)::double AS tp, sum(fp)::double AS fp, sum(fn)::double AS fn, avg(f1) AS macro_f1 FROM m), z AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s) SELECT (SELECT count(*) FROM c) AS cases, (SELECT count(*) FROM c WHERE list_sort(predicted) = list_sort(expected)) AS exact, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(2 * p * r / (p + r), 6) AS micro_f1, round(macro_f1, 6) AS macro_f1 FROM z")
def mapper_evaluation_summary(spark, sf_dir):
    s = evaluation.summary(_cases(spark, sf_dir))
    return s.select("cases", "exact", *(F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")))

"""Queries of the quality and privacy gates, on JSON lines built from the telemetry with known faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlark.operators import gates
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, raw_telemetry
from gridlark.session import tasks, work_dir
from gridlark.sources import jsonl

T = TELEMETRY_SQL


def lines(spark, sf_dir):
    """One JSON line for each event. By seq % 40: 1 broken JSON, 2 a list, 3 no tags, 4 extra field, 5 naive time, 6 text flag, 7 bad payload, 8 blank session, 9 unknown protocol, 10 sanitized with an address; every 50th repeats the id before it."""
    t = raw_telemetry(spark, sf_dir, spread=True)
    m = F.col("seq") % 40
    is_ = lambda n: m == n
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    event_id = F.when((F.col("seq") % 50 == 0) & (F.col("seq") > 0), F.concat(F.lit("evt-"), (F.col("seq") - 1).cast("string"))).otherwise(F.col("event_id"))
    pairs = [
        F.concat(F.lit('"event_id":'), text(event_id)), F.concat(F.lit('"session_id":'), text(F.when(is_(8), " ").otherwise(F.col("session_id")))), F.lit('"sensor_id":"sensor-01"'),
        F.when(is_(5), F.lit('"observed_at":"2024-01-05T10:00:00"')).otherwise(F.lit('"observed_at":"2024-01-05T10:00:00+00:00"')), F.concat(F.lit('"protocol":'), text(F.when(is_(9), "dnp3").otherwise(F.col("protocol")))),
        F.concat(F.lit('"event_type":'), text(F.col("event_type"))), F.concat(F.lit('"decoded":{"operation":'), text(F.col("operation")), F.lit("}")), F.lit('"techniques":[]'), F.when(~is_(3), F.lit('"tags":[]')), F.lit('"severity":"info"'),
        F.when(is_(6), F.lit('"is_demo":"true"')).otherwise(F.lit('"is_demo":true')), F.when(is_(4), F.lit('"note":1')), F.when(is_(7), F.lit('"raw_payload_hex":"abc"')), F.when(is_(10), F.lit('"sanitized":true,"source_id":"src-1"')), F.concat(F.lit('"source_ip":'), text(F.col("source_ip"))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    return t.select(F.col("seq").alias("line_no"), F.when(is_(1), F.substring(body, 1, 30)).when(is_(2), F.lit("[1, 2]")).otherwise(body).alias("value"))


# an id repeats at seq % 50 = 0, unless the line before it (seq % 40 = 1 or 2) had none to repeat
_CODES = """
, l AS (SELECT seq, seq % 40 AS m, (seq % 50 = 0 AND seq > 0 AND (seq - 1) % 40 NOT IN (1, 2) AND seq % 40 NOT IN (1, 2)) AS dup FROM raw),
c AS (SELECT seq AS line_no, m, list_filter([CASE WHEN dup THEN 'duplicate_event_id' END, CASE m WHEN 3 THEN 'invalid_tags_list' WHEN 5 THEN 'invalid_timestamp' WHEN 6 THEN 'invalid_classification' WHEN 7 THEN 'invalid_raw_payload' WHEN 8 THEN 'invalid_session_id' WHEN 1 THEN 'malformed_json' END,
  CASE m WHEN 3 THEN 'missing_required_fields' WHEN 10 THEN 'private_fields_in_sanitized_record' WHEN 2 THEN 'record_not_object' WHEN 4 THEN 'unexpected_top_level_fields' WHEN 9 THEN 'unsupported_protocol' END], lambda x: x IS NOT NULL) AS codes FROM l)
"""


@query("preflight_errors", T + _CODES + "SELECT line_no, array_to_string(codes, ',') AS codes FROM c")
def preflight_errors(spark, sf_dir):
    return gates.inspect_lines(lines(spark, sf_dir)).select("line_no", F.array_join("codes", ",").alias("codes"))


@query("preflight_report", T + _CODES + "SELECT count(*) AS records, count(*) FILTER (len(codes) = 0) AS valid_records, count(*) FILTER (list_contains(codes, 'duplicate_event_id')) AS duplicate_ids, sum(len(codes))::bigint AS errors, 'synthetic' AS classification, true AS mixed_privacy_state, false AS empty_file FROM c")
def preflight_report(spark, sf_dir):
    return gates.preflight_report(gates.inspect_lines(lines(spark, sf_dir)))


@query("preflight_error_counts", T + _CODES + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM c) GROUP BY code")
def preflight_error_counts(spark, sf_dir):
    return gates.error_counts(gates.inspect_lines(lines(spark, sf_dir)))


def written_lines(spark, sf_dir):
    """The lines as files in the shared folder, in order within each; a file for each range of lines."""
    folder = f"{work_dir(spark)}/handoff"
    lines(spark, sf_dir).repartitionByRange(tasks(spark), "line_no").sortWithinPartitions("line_no").select("value").write.text(folder)
    return folder


@query("handoff_line_numbers", T + _CODES + "SELECT count(*) AS lines, count(DISTINCT line_no) AS numbers, true AS in_order FROM c")
def handoff_line_numbers(spark, sf_dir):
    """Files are read back in small splits: every line has its number in its file, and events follow one another."""
    read = jsonl.read_lines(spark, written_lines(spark, sf_dir))
    seq = F.coalesce(F.regexp_extract("value", '"session_id":"[^"]*-([0-9]+)"', 1).try_cast("long"), F.lit(-1))
    group = read.withColumn("grp", F.when(seq >= 0, seq))
    order = Window.partitionBy("file").orderBy("line_no")
    # in order of their numbers, so a number is new where the one before differs: no set of all of them
    fresh = ~F.col("line_no").eqNullSafe(F.lag("line_no").over(order))
    checked = group.withColumns({"before": F.max("grp").over(order.rowsBetween(Window.unboundedPreceding, -1)), "fresh": fresh}).withColumn("good", F.coalesce(F.col("grp") >= F.col("before"), F.lit(True)))
    return checked.agg(F.count("*").alias("lines"), F.count_if("fresh").alias("numbers"), F.bool_and("good").alias("in_order"))


@query("handoff_error_counts", T + _CODES + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM c) WHERE code <> 'duplicate_event_id' GROUP BY code")
def handoff_error_counts(spark, sf_dir):
    """Error codes of lines read from files; which line of an id comes first depends on the files, so that code is left to the other queries."""
    read = jsonl.read_lines(spark, written_lines(spark, sf_dir))
    return gates.error_counts(gates.inspect_lines(read)).where("code <> 'duplicate_event_id'")


@query("duplicate_event_ids", T + _CODES + "SELECT line_no FROM c WHERE list_contains(codes, 'duplicate_event_id')")
def duplicate_event_ids(spark, sf_dir):
    return gates.inspect_lines(lines(spark, sf_dir)).where(F.array_contains("codes", "duplicate_event_id")).select("line_no")


def public_lines(spark, sf_dir):
    """One public record for each event; by seq % 16: 0 address, 1 payload, 2 network, 3 address in the source, 4 token nested in a list, 5 nested payload, 6 IPv6 in a text, 7 not sanitized, 8 text class, 9 blank source, 10 escaped name, 11 number as source, 12 no JSON, 13 a list."""
    t = raw_telemetry(spark, sf_dir)
    m = F.col("seq") % 16
    is_ = lambda n: m == n
    source = F.when(is_(3), '"src-192.0.2.5"').when(is_(9), '" "').when(is_(11), "7").otherwise(F.concat(F.lit('"'), F.col("source_id"), F.lit('"')))
    decoded = F.when(is_(4), '{"nested":[{"api_token":"x"}]}').when(is_(5), '{"payload":"x"}').when(is_(6), '{"note":"from 2001:db8::1 on"}').when(is_(10), '{"pass\\u0077d":1}').otherwise('{"operation":"key \\"secret\\": no","code":6}')
    extra = F.when(is_(0), ',"source_ip":"192.0.2.5"').when(is_(1), ',"raw_payload_hex":"00"').when(is_(2), ',"source_network":"192.0.2.0/24"').otherwise("")
    body = F.concat(F.lit('{"source_id":'), source, F.lit(',"decoded":'), decoded, F.when(is_(8), ',"is_demo":"true"').otherwise(',"is_demo":true'), F.when(is_(7), ',"sanitized":"yes"').otherwise(',"sanitized":true'), extra, F.lit("}"))
    return t.select(F.col("seq").alias("line_no"), F.when(is_(12), F.substring(body, 1, 20)).when(is_(13), F.lit("[1]")).otherwise(body).alias("value"))


_PUBLIC = """
, p AS (SELECT seq AS line_no, unnest(CASE seq % 16 WHEN 0 THEN ['forbidden_field source_ip', 'address_found '] WHEN 1 THEN ['forbidden_field raw_payload_hex'] WHEN 2 THEN ['address_found '] WHEN 3 THEN ['source_id_is_address source_id', 'address_found ']
  WHEN 4 THEN ['forbidden_field api_token'] WHEN 5 THEN ['forbidden_field payload'] WHEN 6 THEN ['address_found '] WHEN 7 THEN ['not_sanitized sanitized'] WHEN 8 THEN ['no_classification is_demo'] WHEN 9 THEN ['no_source_id source_id']
  WHEN 10 THEN ['forbidden_field passwd'] WHEN 11 THEN ['no_source_id source_id'] WHEN 12 THEN ['malformed_json '] WHEN 13 THEN ['record_not_object '] ELSE [] END) AS e FROM raw)
"""


@query("public_gate", T + _PUBLIC + "SELECT line_no, split_part(e, ' ', 1) AS code, split_part(e, ' ', 2) AS place FROM p")
def public_gate(spark, sf_dir):
    return gates.public_errors(public_lines(spark, sf_dir))


@query("public_gate_report", T + _PUBLIC + "SELECT (SELECT count(*) FROM raw) AS records, count(DISTINCT line_no) AS bad_records, false AS mixed_classification, false AS empty, false AS publishable FROM p")
def public_gate_report(spark, sf_dir):
    return gates.public_report(public_lines(spark, sf_dir))


_NAMES = ["event_id", "Api-Key", "api_token", "userName", "pass_wd", "passwd", "x-secret-y", "Authorization", "cookies", "payload", "tokenizer", "session.token"]


@query("credential_keys", T + f", n AS (SELECT event_id, [{', '.join(repr(n) for n in _NAMES)}][k % {len(_NAMES)} + 1] AS name FROM raw) SELECT event_id, name, name IN ('Api-Key', 'api_token', 'userName', 'passwd', 'x-secret-y', 'Authorization', 'session.token') AS credential, name IN ('Api-Key', 'api_token', 'userName', 'passwd', 'x-secret-y', 'Authorization', 'session.token', 'payload') AS private FROM n")
def credential_keys(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("k") % len(_NAMES) + 1)
    t = raw_telemetry(spark, sf_dir).select("event_id", name.alias("name"))
    return t.select("event_id", "name", gates.credential_like(F.col("name")).alias("credential"), gates.private_key(F.col("name")).alias("private"))


_TEXTS = {
    "src-192.0.2.5": True, "2001:db8::1": True, "198.51.100.0/24": True, "src-a93b8ce2f710": False, "999.1.2.3 and 1.2.3": False, "version 1.2.3.4.5": False, "net 198.51.100.0/40": False, "at 10.0.0.1.": True, "10.0.0.1/path": True, "fe80:0:0:0:1:2:3:4 x": True,
    "1:2:3": False, "12:30:45": False, "64:ff9b::192.0.2.1": True, "::ffff:192.0.2.1": False, "2001:db8::1::2": False, "a.b:c": False, "id 01.2.3.4": False,
}


@query("address_literals", T + f", t AS (SELECT event_id, seq % {len(_TEXTS)} AS m FROM raw) SELECT event_id, m IN ({', '.join(str(k) for k, v in enumerate(_TEXTS.values()) if v)}) AS has_address FROM t")
def address_literals(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("seq") % len(_TEXTS) + 1).cast("int"))
    return raw_telemetry(spark, sf_dir).select("event_id", gates.address_literal(text).alias("has_address"))


def _snapshots(spark, sf_dir):
    k = F.col("k")
    return raw_telemetry(spark, sf_dir).select(
        F.col("event_id").alias("snapshot_id"), (k % 19 != 0).alias("process_running"), F.when(k % 17 == 0, "degraded").when(k % 17 == 1, F.lit(None)).otherwise("ok").alias("status"), F.when(k % 6 != 0, F.lit(10_000) - k * 2).alias("generated_epoch"), F.when(k % 7 != 0, F.lit(10_000) - k * 20).alias("last_event_epoch"),
        (k % 2 == 0).alias("expect_traffic"), (k % 30 / 2).alias("disk_free_percent"), F.when(k % 8 == 0, 3).when(k % 8 == 1, -1).otherwise(0).alias("alert_queue_drops"), F.when(k % 16 == 3, 1).alias("collector_queue_drops"), F.when(k % 16 == 5, 1).otherwise(0).alias("spool_queue_drops"),
        F.when(k % 9 == 0, 1).otherwise(0).alias("delivery_failures"), F.when(k % 11 == 0, 2).otherwise(0).alias("rejected_sessions"), F.when(k % 10 == 0, F.lit(False)).when(k % 10 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("storage_ready"), k.alias("total_events"),
    )


_FIND = """list_filter([CASE WHEN k % 19 = 0 OR k % 17 IN (0, 1) THEN 'process=critical' END, CASE WHEN k % 6 = 0 OR k * 2 > 120 THEN 'snapshot_freshness=critical' END, CASE WHEN k % 2 = 0 AND (k % 7 = 0 OR k * 20 > 900) THEN 'event_freshness=warning' END,
  CASE WHEN k % 30 < 10 THEN 'disk=critical' WHEN k % 30 < 20 THEN 'disk=warning' END, CASE WHEN k % 8 = 0 OR k % 16 IN (3, 5) THEN 'queue_drops=warning' END, CASE WHEN k % 9 = 0 THEN 'delivery=warning' END, CASE WHEN k % 11 = 0 THEN 'session_capacity=warning' END,
  CASE WHEN k % 10 = 0 THEN 'collector_storage=critical' WHEN k % 10 = 1 THEN 'collector_storage=warning' END], lambda x: x IS NOT NULL)"""


@query("health_findings", T + f", h AS (SELECT event_id AS snapshot_id, {_FIND} AS f FROM raw), e AS (SELECT *, CASE WHEN len(list_filter(f, lambda x: x LIKE '%=critical')) > 0 THEN 2 WHEN len(f) > 0 THEN 1 ELSE 0 END AS exit_code FROM h) SELECT snapshot_id, array_to_string(f, ', ') AS findings, ['ok', 'warning', 'critical'][exit_code + 1] AS status, exit_code::int AS exit_code FROM e")
def health_findings(spark, sf_dir):
    return gates.health_findings(_snapshots(spark, sf_dir), F.lit(10_000))


@query(
    "operator_assurance",
    T + """SELECT event_id AS snapshot_id, CASE WHEN k % 17 IN (0, 1) THEN 'reported unhealthy' ELSE 'reported healthy' END AS state, CASE WHEN k % 6 <> 0 THEN 10000 - k * 2 END AS generated_epoch, CASE WHEN k % 7 <> 0 THEN 10000 - k * 20 END AS last_event_epoch, k::bigint AS total_events,
  CASE WHEN k % 8 = 0 OR k % 16 = 3 THEN 'attention needed' ELSE 'no drops reported' END AS queue_state, CASE WHEN k % 9 = 0 THEN 'attention needed' ELSE 'no failures reported' END AS delivery_state,
  CASE WHEN k % 11 = 0 THEN 'sessions rejected' ELSE 'no rejections reported' END AS capacity_state, CASE WHEN k % 10 = 0 THEN 'not writable' WHEN k % 10 = 1 THEN 'not reported' ELSE 'ready' END AS storage_state FROM raw""",
)
def operator_assurance(spark, sf_dir):
    return gates.operator_assurance(_snapshots(spark, sf_dir))

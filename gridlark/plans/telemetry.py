"""Telemetry from the driver's ``events`` table: the adapter, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.functions import crypto, enrich
from gridlark.session import tasks

#: Function codes that the adapter deals to Modbus events by k % 10.
FUNCTION_CODES = (1, 2, 3, 4, 5, 6, 15, 16, 43, 90)
SENSOR = "sensor-01"
FINGERPRINT_SECRET = b"synthetic-fingerprint-secret-0001"
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def raw_telemetry(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Events in the telemetry schema, before enrichment; dealt to all tasks when ``spread``, where a row means much work: a split of the file holds millions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if spread:
        events = events.repartition(tasks(spark), "event_id")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("nation_key"), F.col("n_name").alias("source_country"))
    k, user = F.col("k"), F.col("user_id")
    m = F.col("event_id") % 25
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("protocol", F.when(m < 14, "modbus").when(m < 20, "s7").otherwise("iec104"))
    e = e.withColumn("kind", F.when(F.col("event_type") == "view", "connection").when(F.col("event_type") == "error", "known_exploit_probe").otherwise("protocol_request"))
    e = e.withColumn("function_code", F.when(F.col("protocol") == "modbus", F.element_at(F.array(*map(F.lit, FUNCTION_CODES)), k % 10 + 1)))
    # function codes 5 and 6 stand at 4 and 5 of FUNCTION_CODES, 15 and 16 at 6 and 7
    operation = (
        F.when(F.col("protocol") == "modbus", F.when((k % 10).isin(4, 5), "write_single").when((k % 10).isin(6, 7), "write_multiple").otherwise("device_probe"))
        .when(F.col("protocol") == "s7", F.when(k % 5 == 0, "program_download").otherwise("connection_setup"))
        .otherwise(F.when(k % 10 % 3 == 0, "interrogation").when(k % 10 % 3 == 1, "single_command").otherwise("setpoint_command"))
    )
    e = e.withColumn("operation", operation).withColumn("source_ip", F.concat(F.lit("192.0.2."), (user % 20 + 1).cast("string")))
    e = e.join(nation, user % 25 == F.col("nation_key"), "left")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(user.cast("string"), F.lit("-"), F.floor(F.col("event_id") / 3).cast("string")).alias("session_id"),
        F.lit(SENSOR).alias("sensor_id"),
        F.col("ts").alias("observed_at"),
        F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("observed_epoch"),
        "k",
        "protocol",
        F.col("kind").alias("event_type"),
        "operation",
        "function_code",
        F.when((F.col("kind") == "known_exploit_probe") & (k % 2 == 0), "TEST-SIGNATURE").alias("signature"),
        "source_ip",
        crypto.pseudonym(F.col("source_ip"), crypto.SYNTHETIC_SALT).alias("source_id"),
        "source_country",
        F.when(k == 0, F.lit(95.0)).when(k == 1, F.lit(None).cast("double")).otherwise(user * 37 % 181 - 90 + F.col("value") / 1000).alias("source_latitude"),
        F.when(k == 2, F.lit(181.0)).otherwise((user * 53 % 361 - 180).cast("double")).alias("source_longitude"),
        F.encode(F.concat(F.col("protocol"), F.col("operation"), (k % 10).cast("string")), "UTF-8").alias("payload"),
    )


def telemetry(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Enriched events: techniques, severity, triage and completeness."""
    t = raw_telemetry(spark, sf_dir, spread)
    found = enrich.evidence(*map(F.col, ("protocol", "event_type", "operation", "function_code", "signature")))
    t = t.select("*", *(c.alias(f"has_{name}") for name, c in found.items()))
    e = {name: F.col(f"has_{name}") for name in found}
    t = t.withColumns(
        {
            "techniques": enrich.techniques_of(e),
            "technique_ids": enrich.technique_ids_of(e),
            "severity": enrich.severity_of(e),
            "mapping_confidence": enrich.confidence_of(e),
            "triage_score": enrich.score_of(e, F.col("operation"), F.col("function_code")),
        }
    )
    t = t.withColumn("priority", enrich.priority_of(F.col("triage_score")))
    t = t.withColumn("factors", enrich.triage_factors(*map(F.col, ("event_type", "operation", "function_code", "signature", "techniques"))))
    complete = enrich.completeness(F.col("operation").isNotNull(), F.lit(True), F.col("session_id"), F.coalesce(F.substring("source_country", 1, 2), F.lit("ZZ")), F.col("source_latitude"), F.col("source_longitude"), F.col("techniques"))
    return t.withColumn("completeness", complete)


_COMMANDS = ", ".join(f"'{o}'" for o in C.COMMANDS)
_VIEW_CONTROLS = ", ".join(f"'{o}'" for o in C.CONTROL_IN_VIEWS)
_PROBES = ", ".join(f"'{o}'" for o in C.PROBES)
VIEW_CONTROLS_SQL = _VIEW_CONTROLS

#: Common table expressions of every oracle: ``raw`` and ``tel`` (enriched).
TELEMETRY_SQL = f"""
WITH raw0 AS (
  SELECT event_id AS seq, ts AS observed_at, CAST(floor(epoch(ts)) AS bigint) AS observed_epoch, user_id, value, event_id % 25 AS m, floor(event_id / 3.0)::bigint AS grp,
    CAST(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS int) AS k,
    CASE event_type WHEN 'view' THEN 'connection' WHEN 'error' THEN 'known_exploit_probe' ELSE 'protocol_request' END AS event_type
  FROM events
), raw1 AS (
  SELECT *, CASE WHEN m < 14 THEN 'modbus' WHEN m < 20 THEN 's7' ELSE 'iec104' END AS protocol,
    CASE WHEN m < 14 THEN [{', '.join(map(str, FUNCTION_CODES))}][k % 10 + 1] END AS function_code FROM raw0
), raw2 AS (
  SELECT *, CASE protocol WHEN 'modbus' THEN CASE WHEN function_code IN (5, 6) THEN 'write_single' WHEN function_code IN (15, 16) THEN 'write_multiple' ELSE 'device_probe' END
    WHEN 's7' THEN CASE WHEN k % 5 = 0 THEN 'program_download' ELSE 'connection_setup' END
    ELSE CASE k % 10 % 3 WHEN 0 THEN 'interrogation' WHEN 1 THEN 'single_command' ELSE 'setpoint_command' END END AS operation FROM raw1
), raw AS (
  SELECT seq, 'evt-' || seq AS event_id, user_id || '-' || grp AS session_id, '{SENSOR}' AS sensor_id, observed_at, observed_epoch, k, protocol, event_type, operation, function_code,
    CASE WHEN event_type = 'known_exploit_probe' AND k % 2 = 0 THEN 'TEST-SIGNATURE' END AS signature,
    '192.0.2.' || (user_id % 20 + 1) AS source_ip, 'src-' || substr(sha256('{crypto.SYNTHETIC_SALT}|192.0.2.' || (user_id % 20 + 1)), 1, 12) AS source_id,
    n_name AS source_country,
    CASE WHEN k = 0 THEN 95.0::double WHEN k = 1 THEN NULL ELSE user_id * 37 % 181 - 90 + value / 1000 END AS source_latitude,
    CASE WHEN k = 2 THEN 181.0::double ELSE (user_id * 53 % 361 - 180)::double END AS source_longitude,
    protocol || operation || (k % 10) AS payload_text
  FROM raw2 LEFT JOIN nation ON user_id % 25 = n_nationkey
), ev AS (
  SELECT *, event_type IN ('protocol_request', 'known_exploit_probe') AS evidence, coalesce(signature, '') <> '' AND event_type = 'known_exploit_probe' AS has_sig,
    event_type IN ('protocol_request', 'known_exploit_probe') AND operation IN ({_PROBES}) AS has_probe,
    event_type IN ('protocol_request', 'known_exploit_probe') AND protocol = 'modbus' AND coalesce(function_code IN (1, 2, 3, 4), false) AS has_read,
    event_type IN ('protocol_request', 'known_exploit_probe') AND operation IN ({_COMMANDS}) AS has_cmd,
    event_type IN ('protocol_request', 'known_exploit_probe') AND operation = 'program_download' AS has_prog,
    source_latitude IS NOT NULL AND source_longitude IS NOT NULL AND source_latitude BETWEEN -90 AND 90 AND source_longitude BETWEEN -180 AND 180 AS plotted
  FROM raw
), ev2 AS (
  SELECT *, list_filter([CASE WHEN has_probe THEN 'T0846.001' END, CASE WHEN has_read THEN 'T0877' END, CASE WHEN has_cmd THEN 'T1692.001' END, CASE WHEN has_cmd THEN 'T0836' END, CASE WHEN has_prog THEN 'T0843' END, CASE WHEN has_sig THEN 'T0866' END], lambda x: x IS NOT NULL) AS technique_ids,
    CASE WHEN has_prog OR has_sig OR has_cmd THEN 'high' WHEN has_read THEN 'medium' ELSE 'info' END AS severity,
    CASE WHEN has_prog OR has_sig OR has_cmd THEN 'high' WHEN has_probe THEN 'medium' WHEN has_read THEN 'low' ELSE 'none' END AS confidence,
    operation IN ({_COMMANDS}) AS is_cmd, operation = 'program_download' AS is_prog, coalesce(function_code IN (1, 2, 3, 4), false) AS is_read, operation IN ({_PROBES}) AS is_probe
  FROM ev
), ev3 AS (
  SELECT *, list_filter([CASE WHEN is_cmd THEN 'control_command (+40)' END, CASE WHEN is_prog THEN 'program_transfer (+45)' END, CASE WHEN NOT is_cmd AND NOT is_prog AND is_read THEN 'process_read (+15)' END,
      CASE WHEN NOT is_cmd AND NOT is_prog AND is_probe THEN 'protocol_probe (+10)' END, CASE WHEN has_sig THEN 'exploit_signature (+35)' END,
      CASE confidence WHEN 'low' THEN 'mapped_evidence (+5)' WHEN 'medium' THEN 'mapped_evidence (+10)' WHEN 'high' THEN 'mapped_evidence (+20)' END], lambda x: x IS NOT NULL) AS factor_list,
    CAST(least(100, CASE WHEN is_cmd THEN 40 WHEN is_prog THEN 45 ELSE (CASE WHEN is_read THEN 15 ELSE 0 END) + (CASE WHEN is_probe THEN 10 ELSE 0 END) END + CASE WHEN has_sig THEN 35 ELSE 0 END
      + CASE confidence WHEN 'low' THEN 5 WHEN 'medium' THEN 10 WHEN 'high' THEN 20 ELSE 0 END) AS int) AS triage_score
  FROM ev2
), tel AS (
  SELECT *, CASE WHEN triage_score >= 75 THEN 'urgent review' WHEN triage_score >= 50 THEN 'high review' WHEN triage_score >= 25 THEN 'elevated review' WHEN triage_score > 0 THEN 'routine review' ELSE 'informational' END AS priority,
    CASE WHEN len(factor_list) > 0 THEN array_to_string(factor_list, '; ') ELSE 'No scored protocol evidence.' END AS factors,
    1 + 1 + CASE WHEN source_country IS NOT NULL AND source_latitude IS NOT NULL AND source_longitude IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(technique_ids) > 0 THEN 1 ELSE 0 END AS checks_met
  FROM ev3
)
"""

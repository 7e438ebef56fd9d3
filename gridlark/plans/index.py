"""Queries of the observation index and the reports on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.functions import crypto, enrich
from gridlark.operators import index
from gridlark.plans.registry import query
from gridlark.plans.telemetry import FINGERPRINT_SECRET, TELEMETRY_SQL, telemetry

T = TELEMETRY_SQL
_IN, _OUT = crypto.hmac_pads(FINGERPRINT_SECRET)
FP = f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(source_ip) || '\\x00'::BLOB || encode(protocol) || '\\x00'::BLOB || encode(payload_text))))"


def _indexed(spark, sf_dir):
    return index.with_fingerprint(telemetry(spark, sf_dir), FINGERPRINT_SECRET)


@query("fingerprint_hmac", T + f"SELECT event_id, {FP} AS fingerprint FROM tel")
def fingerprint_hmac(spark, sf_dir):
    return _indexed(spark, sf_dir).select("event_id", "fingerprint")


@query("repeat_and_novelty", T + f", f AS (SELECT *, {FP} AS fingerprint FROM tel) SELECT event_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) AS int) AS repeat_source_count, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1 AS novel FROM f")
def repeat_and_novelty(spark, sf_dir):
    return index.repeat_and_novelty(_indexed(spark, sf_dir)).select("event_id", "repeat_source_count", "novel")


@query(
    "index_scores",
    T + f", f AS (SELECT *, {FP} AS fingerprint FROM tel), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1 AS novel FROM f) SELECT event_id, CAST(least(100, CASE WHEN is_cmd THEN 40 WHEN is_prog THEN 45 ELSE (CASE WHEN is_read THEN 15 ELSE 0 END) + (CASE WHEN is_probe THEN 10 ELSE 0 END) END + CASE WHEN has_sig THEN 35 ELSE 0 END + CASE confidence WHEN 'low' THEN 5 WHEN 'medium' THEN 10 WHEN 'high' THEN 20 ELSE 0 END + CASE WHEN n >= 5 THEN 15 WHEN n > 1 THEN 10 ELSE 0 END + CASE WHEN novel THEN 5 ELSE 0 END) AS int) AS threat_score FROM r",
)
def index_scores(spark, sf_dir):
    t = index.repeat_and_novelty(_indexed(spark, sf_dir))
    e = {name: F.col(f"has_{name}") for name in ("probe", "read", "command", "program", "exploit")}
    return t.select("event_id", enrich.score_of(e, F.col("operation"), F.col("function_code"), F.col("repeat_source_count"), F.col("novel")).alias("threat_score"))


def islands_sql(window: int) -> str:
    return f""", o AS (SELECT *, {FP} AS fingerprint FROM tel), g AS (SELECT *, observed_epoch - lag(observed_epoch) OVER (PARTITION BY fingerprint ORDER BY seq) AS gap FROM o),
isl AS (SELECT *, CAST(sum(CASE WHEN gap > {window} THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM g),
idx AS (SELECT fingerprint, source_id, protocol, island, min(seq) AS first_seq, min(observed_epoch) AS first_seen, max(observed_epoch) AS last_seen, count(*) AS repeat_count, arg_min(event_id, seq) AS event_id, arg_min(session_id, seq) AS session_id, arg_min(severity, seq) AS severity, arg_min(technique_ids, seq) AS technique_ids FROM isl GROUP BY fingerprint, source_id, protocol, island)
"""


_KEYS = ["fingerprint", "source_id", "protocol"]
_COLS = "fingerprint, island, first_seq, first_seen, last_seen, repeat_count, event_id, session_id, severity"


def merged(spark, sf_dir, window):
    # a count of a Parquet table is read from the ends of its files
    return index.merged_observations(_indexed(spark, sf_dir), window, _KEYS, spark.read.parquet(f"{sf_dir}/events.parquet").count())


@query("dedup_observations_30m", T + islands_sql(1800) + f"SELECT {_COLS} FROM idx")
def dedup_observations_30m(spark, sf_dir):
    return merged(spark, sf_dir, 1800).select(*_COLS.split(", "))


@query("dedup_observations_6h", T + islands_sql(21600) + f"SELECT {_COLS} FROM idx")
def dedup_observations_6h(spark, sf_dir):
    return merged(spark, sf_dir, 21600).select(*_COLS.split(", "))


#: Every seventh event comes up to three hours late or early by its own clock.
_SHIFT = "CASE WHEN seq % 7 = 3 THEN (seq * 7919 % 11 - 5) * 2160 ELSE 0 END"


@query(
    "dedup_late_observations",
    (T + f""", o AS (SELECT source_id || '|' || protocol AS fingerprint, seq, event_id, CAST(observed_epoch + {_SHIFT} AS bigint) AS t FROM tel),
n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS i FROM o),
f AS (SELECT fingerprint, i, [t] AS lasts, 1::bigint AS k FROM n WHERE i = 1
  UNION ALL SELECT fingerprint, i, CASE WHEN k > len(lasts) THEN list_append(lasts, t) ELSE list_concat(lasts[1 : k - 1], [t], lasts[k + 1 :]) END, k
  FROM (SELECT n.fingerprint, n.i, n.t, lasts, coalesce(list_position(lasts, list_max(list_filter(lasts, lambda x: x <= n.t AND x >= n.t - 1800))), len(lasts) + 1)::bigint AS k FROM f JOIN n ON n.fingerprint = f.fingerprint AND n.i = f.i + 1))
SELECT fingerprint, k - 1 AS island, min(seq) AS first_seq, arg_min(event_id, seq) AS event_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS repeat_count FROM f JOIN n USING (fingerprint, i) GROUP BY ALL""").replace("WITH raw0", "WITH RECURSIVE raw0"),
)
def dedup_late_observations(spark, sf_dir):
    """Observations of a source and protocol, some of them late: the reference result is a fold in order of arrival."""
    t = telemetry(spark, sf_dir).select(F.concat_ws("|", "source_id", "protocol").alias("fingerprint"), "seq", "event_id", (F.col("observed_epoch") + F.expr(_SHIFT)).alias("observed_epoch"))
    return index.merged_observations(t, 1800).select("fingerprint", "island", "first_seq", "event_id", "first_seen", "last_seen", "repeat_count")


_CONF = "CASE tid WHEN 'T0877' THEN 'low' WHEN 'T0846.001' THEN 'medium' WHEN 'T0836' THEN 'medium' ELSE 'high' END"
_TOTALS = islands_sql(21600) + f", x AS (SELECT *, unnest(technique_ids) AS tid FROM idx), tot AS (SELECT tid AS technique_id, {_CONF} AS confidence, sum(repeat_count)::bigint AS total FROM x GROUP BY ALL)"


@query("navigator_layer", T + _TOTALS + ", n AS (SELECT technique_id, sum(total)::bigint AS score, array_to_string(list_sort(list(confidence || '=' || total)), ', ') AS confidences FROM tot GROUP BY 1) SELECT *, (SELECT max(score) FROM n) AS max_score FROM n")
def navigator_layer(spark, sf_dir):
    return index.navigator_layer(merged(spark, sf_dir, 21600))


_REPORT_END = 1_706_400_000  # 2024-01-28


@query("report_totals", T + islands_sql(21600) + f"SELECT coalesce(sum(repeat_count), 0)::bigint AS events, count(DISTINCT session_id) AS sessions FROM idx WHERE last_seen >= {_REPORT_END} - 604800 AND last_seen < {_REPORT_END}")
def report_totals(spark, sf_dir):
    return index.report_totals(index.report_window(merged(spark, sf_dir, 21600), _REPORT_END, 7))


@query("report_protocols", T + islands_sql(21600) + f", w AS (SELECT * FROM idx WHERE last_seen >= {_REPORT_END} - 604800 AND last_seen < {_REPORT_END}) SELECT p AS protocol, coalesce((SELECT sum(repeat_count) FROM w WHERE protocol = p), 0)::bigint AS events FROM (SELECT unnest(['modbus', 's7', 'iec104']) AS p)")
def report_protocols(spark, sf_dir):
    return index.report_protocols(index.report_window(merged(spark, sf_dir, 21600), _REPORT_END, 7))


_WINDOWED = _TOTALS.replace("FROM idx)", f"FROM idx WHERE last_seen >= {_REPORT_END} - 604800 AND last_seen < {_REPORT_END})")


@query("report_top_techniques", T + _WINDOWED + " SELECT technique_id, sum(total)::bigint AS events, coalesce(sum(total) FILTER (confidence = 'high'), 0)::bigint AS high, coalesce(sum(total) FILTER (confidence = 'medium'), 0)::bigint AS medium, coalesce(sum(total) FILTER (confidence = 'low'), 0)::bigint AS low FROM tot GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def report_top_techniques(spark, sf_dir):
    return index.report_top_techniques(index.report_window(merged(spark, sf_dir, 21600), _REPORT_END, 7))


@query("report_top_sources", T + islands_sql(21600) + f"SELECT source_id, count(DISTINCT session_id) FILTER (session_id <> '') AS sessions FROM idx WHERE last_seen >= {_REPORT_END} - 604800 AND last_seen < {_REPORT_END} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def report_top_sources(spark, sf_dir):
    return index.report_top_sources(index.report_window(merged(spark, sf_dir, 21600), _REPORT_END, 7))


def _counter_sql(column: str, names) -> str:
    parts = ", ".join(f"CASE WHEN count(*) FILTER ({column} = '{n}') > 0 THEN '{n}=' || count(*) FILTER ({column} = '{n}') END" for n in sorted(names))
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ', ')"


_TECH = ", ".join(f"CASE WHEN count(*) FILTER (list_contains(technique_ids, '{n}')) > 0 THEN '{n}=' || count(*) FILTER (list_contains(technique_ids, '{n}')) END" for n in sorted(C.TECHNIQUES))


@query(
    "public_summary",
    T + f"SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT source_id) AS sources, {_counter_sql('protocol', C.PROTOCOLS)} AS protocols, {_counter_sql('severity', C.SEVERITY_RANK)} AS severities, {_counter_sql('event_type', ('connection', 'protocol_request', 'session_error', 'known_exploit_probe'))} AS event_types, array_to_string(list_filter([{_TECH}], lambda x: x IS NOT NULL), ', ') AS techniques, substr(CAST(min(observed_at) AS varchar), 1, 10) AS first_date, substr(CAST(max(observed_at) AS varchar), 1, 10) AS last_date FROM tel",
)
def public_summary(spark, sf_dir):
    return index.public_summary(telemetry(spark, sf_dir))


@query("import_idempotence", T + "SELECT count(*) AS accepted, count(*) FILTER (seq % 3 <> 0) AS imported, count(*) FILTER (seq % 3 = 0 AND seq % 30 <> 0) AS skipped, count(*) FILTER (seq % 30 = 0) AS conflicts FROM tel WHERE seq % 2 = 0")
def import_idempotence(spark, sf_dir):
    """Every second event comes; the ledger holds every third, every thirtieth with other content."""
    t = telemetry(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", "event_id", "session_id", "operation"), 256))
    ledger = t.where("seq % 3 = 0").select("event_id", F.when(F.col("seq") % 30 == 0, "changed").otherwise(F.col("digest")).alias("digest"))
    return index.import_counts(t.where("seq % 2 = 0"), ledger)


@query("imported_rows", T + "SELECT event_id FROM tel WHERE seq % 2 = 0 AND seq % 3 <> 0")
def imported_rows(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", "event_id", "session_id", "operation"), 256))
    return index.import_batch(t.where("seq % 2 = 0"), t.where("seq % 3 = 0")).select("event_id")


@query("health_counters", T + "SELECT 'protocol' AS counter, protocol AS name, count(*) AS n FROM tel GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM tel GROUP BY ALL")
def health_counters(spark, sf_dir):
    return index.health_counters(telemetry(spark, sf_dir))


@query("spool_admission", T + ", s AS (SELECT event_id, seq, source_id, length(payload_text) AS size FROM tel), r AS (SELECT *, count(*) OVER w AS rank, sum(size) OVER w AS held FROM s WINDOW w AS (PARTITION BY source_id ORDER BY seq)) SELECT event_id, rank <= 300 AND held <= 4000 AS admitted FROM r")
def spool_admission(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", "seq", "source_id", F.octet_length("payload").alias("size"))
    return index.spool_admission(rows, 300, 4000, "source_id").select("event_id", "admitted")

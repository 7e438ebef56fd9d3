"""Queries of an analyst's workspace: saved views, focus, orders, exact medians, report counters, rule fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.functions import enrich
from gridlark.functions.enrich import valid_coordinates
from gridlark.operators import detection, views, workspace
from gridlark.plans.dashboard import _GRID, _METRICS, POINTS
from gridlark.plans.detection import PACK
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, VIEW_CONTROLS_SQL, raw_telemetry, telemetry
from gridlark.session import work_dir
from gridlark.sources import cases, foreign, jsonl
from gridlark.sources.rules import read_pack

T = TELEMETRY_SQL
VIEW = workspace.View({"protocols": ["s7", "modbus", "modbus"], "severities": ["high", "medium"]}, control_only=True, window="Last 14 days", selection={"source": "x", "country": "y", "protocol": "s7", "events": "-3"})
_VIEWED = f", s AS (SELECT * FROM tel WHERE protocol IN ('s7', 'modbus') AND severity IN ('high', 'medium') AND operation IN ({VIEW_CONTROLS_SQL})), v AS (SELECT * FROM s WHERE observed_epoch >= (SELECT max(observed_epoch) FROM s) - 14 * 86400)"


@query("view_manifest", T + _VIEWED + f" SELECT '{VIEW.digest()}' AS filters, count(*) AS filtered_events, count(*) FILTER (plotted) AS mapped_events, count(*) FILTER (NOT plotted) AS excluded_events, count(DISTINCT source_id) FILTER (plotted) AS mapped_sources, count(DISTINCT coalesce(source_country, 'Unknown')) FILTER (plotted) AS mapped_countries FROM v")
def view_manifest(spark, sf_dir):
    """A view is saved as text, read back, and its counts are taken from the view that was read."""
    t = telemetry(spark, sf_dir)
    again = workspace.from_snapshot(workspace.to_snapshot(t, VIEW, is_demo=True))
    counts = workspace.manifest(t, again, is_demo=True)["aggregate_counts"]
    return spark.createDataFrame([(again.digest(), *counts.values())], "filters string, " + ", ".join(f"{c} long" for c in counts))


@query("replayed_view", T + _VIEWED + " SELECT event_id FROM v")
def replayed_view(spark, sf_dir):
    """The events of a view that went through its saved text."""
    t = telemetry(spark, sf_dir)
    return workspace.from_snapshot(workspace.to_snapshot(t, VIEW, is_demo=True)).apply(t).select("event_id")


@query("custom_range", T + "SELECT event_id FROM tel WHERE observed_at >= TIMESTAMP '2024-01-03' AND observed_at < TIMESTAMP '2024-01-06'")
def custom_range(spark, sf_dir):
    return workspace.custom_range(telemetry(spark, sf_dir), "2024-01-03", "2024-01-05").select("event_id")


_FIRST_SOURCE = "(SELECT min(source_id) FROM tel)"


@query("focused_events", T + f"SELECT event_id FROM tel WHERE list_contains(technique_ids, 'T0836') AND source_id = {_FIRST_SOURCE} AND protocol = 'modbus'")
def focused_events(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return workspace.focused(t, "T0836", t.agg(F.min("source_id")).first()[0], "modbus").select("event_id")


@query("focused_predictions", T + "SELECT event_id FROM tel WHERE event_type = 'protocol_request' AND protocol = 'modbus' AND operation IN ('write_single', 'write_multiple')")
def focused_predictions(spark, sf_dir):
    found = detection.predictions(telemetry(spark, sf_dir), read_pack(PACK))
    return workspace.focused_predictions(workspace.prediction_order(found), ["Sigma"], ["modbus", "s7"], "gl_modbus_write").select("event_id")


@query("selected_source_events", T + f", p AS ({POINTS}), one AS (SELECT * FROM p ORDER BY events DESC, public_review_score DESC, country, source, protocol LIMIT 1) SELECT event_id FROM tel JOIN one ON tel.source_id = one.source AND coalesce(tel.source_country, 'Unknown') = one.country AND tel.protocol = one.protocol")
def selected_source_events(spark, sf_dir):
    """Events of the standout point, selected on the map."""
    t = telemetry(spark, sf_dir)
    points = views.map_points(t)
    one = workspace.selection_of(views.standout_point(points)).first().asDict()
    return workspace.of_selected(t, workspace.safe_selection(one)).select("event_id")


_NEWEST = "SELECT event_id, CAST(row_number() OVER (ORDER BY observed_epoch DESC, seq DESC) AS int) AS place FROM tel ORDER BY place LIMIT "


@query("recent_observations", T + _NEWEST + "4")
def recent_observations(spark, sf_dir):
    return workspace.recent_observations(telemetry(spark, sf_dir)).select("event_id", "place")


@query("evidence_timeline", T + _NEWEST + "20")
def evidence_timeline(spark, sf_dir):
    return workspace.evidence_timeline(telemetry(spark, sf_dir)).select("event_id", "place")


@query("session_ledger", T + "SELECT event_id, observed_epoch FROM tel WHERE session_id = (SELECT max(session_id) FROM tel)")
def session_ledger(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return workspace.session_ledger(t, t.agg(F.max("session_id")).first()[0]).select("event_id", "observed_epoch")


@query("compared_sources", T + f"SELECT source, country, protocol, events, public_review_score FROM ({POINTS}) ORDER BY public_review_score DESC, events DESC, source, country, protocol LIMIT 3")
def compared_sources(spark, sf_dir):
    points = views.map_points(telemetry(spark, sf_dir)).orderBy("country", "protocol")
    best = points.orderBy(F.desc("public_review_score"), F.desc("events"), "source", "country", "protocol").limit(3)
    return workspace.compared_sources(best).select("source", "country", "protocol", "events", "public_review_score")


@query("playback_order", T + _GRID + "SELECT time_bucket, protocol, events, source FROM grid")
def playback_order(spark, sf_dir):
    grid = views.playback_grid(views.playback(telemetry(spark, sf_dir)))
    return workspace.playback_order(grid).select("time_bucket", "protocol", "events", "source")


@query("accessible_table", T + f"SELECT source, country, protocol, events, sessions FROM ({POINTS})")
def accessible_table(spark, sf_dir):
    return workspace.accessible_table(views.map_points(telemetry(spark, sf_dir))).select("source", "country", "protocol", "events", "sessions")


@query("leading_protocol", T + "SELECT protocol, count(*) AS events FROM tel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def leading_protocol(spark, sf_dir):
    return workspace.leading_protocol(telemetry(spark, sf_dir))


@query("most_common_operations", T + ", c AS (SELECT operation AS name, count(*) AS events, min(seq) AS s FROM tel GROUP BY 1) SELECT name, events, CAST(row_number() OVER (ORDER BY events DESC, s) AS int) AS place FROM c ORDER BY place LIMIT 5")
def most_common_operations(spark, sf_dir):
    return workspace.most_common(telemetry(spark, sf_dir), "operation", 5)


@query(
    "ordered_options",
    T + """, o AS (SELECT DISTINCT 'protocol' AS field, protocol AS value FROM tel UNION SELECT DISTINCT 'severity', severity FROM tel UNION SELECT DISTINCT 'priority', priority FROM tel UNION SELECT DISTINCT 'mapping_confidence', confidence FROM tel)
SELECT field, value, CAST(row_number() OVER (PARTITION BY field ORDER BY CASE field WHEN 'severity' THEN list_position(['info', 'low', 'medium', 'high'], value) WHEN 'priority' THEN list_position(['urgent review', 'high review', 'elevated review', 'routine review', 'informational'], value) WHEN 'mapping_confidence' THEN list_position(['none', 'low', 'medium', 'high'], value) ELSE 0 END, value) AS int) AS place FROM o""",
)
def ordered_options(spark, sf_dir):
    return workspace.ordered_options(telemetry(spark, sf_dir), ["protocol", "severity", "priority", "mapping_confidence"])


_SAID = """, w AS (SELECT metric, current_window AS c, previous_window AS p, change AS d, CASE metric WHEN 'Events' THEN 0 WHEN 'Sessions' THEN 1 WHEN 'Control actions' THEN 2 ELSE 3 END AS k FROM x WHERE change <> 0), y AS (SELECT k, CASE WHEN p = 0 THEN metric || ': ' || format('{:,}', c) || ' now, none before' ELSE metric || CASE WHEN d > 0 THEN ' up' ELSE ' down' END || ' by ' || format('{:,}', abs(d)) || ' (' || format('{:,}', p) || ' to ' || format('{:,}', c) || ')' END AS s FROM w ORDER BY k LIMIT 2)
SELECT CASE WHEN count(*) = 0 THEN 'No count changed between the windows.' ELSE string_agg(s, '; ' ORDER BY k) || '. Counts of recorded windows; no rate or cause.' END AS said FROM y"""


@query("change_text", T + _METRICS.replace(") SELECT metric, current_window, previous_window, current_window - previous_window AS change FROM m", "), x AS (SELECT metric, current_window, previous_window, current_window - previous_window AS change FROM m)") + _SAID)
def change_text(spark, sf_dir):
    return spark.createDataFrame([(workspace.change_text(views.window_comparison(telemetry(spark, sf_dir), 7)),)], "said string")


@query("point_labels", T + f"SELECT source, country, protocol, substr(sha256(source || '|' || country || '|' || protocol), 1, 16) AS review_key, greatest(0, events - sessions) AS repeat_observations, strftime(make_timestamp(last_seen * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS last_seen FROM ({POINTS})")
def point_labels(spark, sf_dir):
    p = views.map_points(telemetry(spark, sf_dir))
    return p.select("source", "country", "protocol", workspace.review_key(F.col("source"), F.col("country"), F.col("protocol")).alias("review_key"), workspace.repeat_observations(F.col("events"), F.col("sessions")).alias("repeat_observations"), workspace.safe_iso(F.col("last_seen")).alias("last_seen"))


@query("mapping_states", T + "SELECT CASE WHEN len(technique_ids) > 0 THEN 'mapped hypothesis' ELSE 'no mapped technique' END AS state, count(*) AS events FROM tel GROUP BY 1")
def mapping_states(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(workspace.mapping_state(F.col("techniques")).alias("state")).agg(F.count("*").alias("events"))


@query("exact_medians", T + "SELECT source_id, protocol, round(median(source_latitude), 6) AS latitude FROM tel WHERE plotted GROUP BY ALL")
def exact_medians(spark, sf_dir):
    """Medians of a group's coordinates without ordering the group's rows in one task."""
    t = telemetry(spark, sf_dir).where(valid_coordinates(F.col("source_latitude"), F.col("source_longitude")))
    return workspace.exact_medians(t, ["source_id", "protocol"], "source_latitude").select("source_id", "protocol", F.round("median", 6).alias("latitude"))


@query("focus_viewpoint", T + f"SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, 3.6::double AS zoom FROM ({POINTS}) ORDER BY events DESC, public_review_score DESC, country, source, protocol LIMIT 1")
def focus_viewpoint(spark, sf_dir):
    points = views.map_points(telemetry(spark, sf_dir))
    one = views.standout_point(points).first().asDict()
    v = workspace.focus_viewpoint(points, one)
    return v.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("latitude", "longitude", "zoom")))


@query(
    "report_counters",
    T + """SELECT 'protocol' AS counter, protocol AS name, count(*) AS n FROM tel GROUP BY ALL UNION ALL SELECT 'operation', operation, count(*) FROM tel GROUP BY ALL UNION ALL SELECT 'technique', tid, count(*) FROM (SELECT unnest(technique_ids) AS tid FROM tel) GROUP BY ALL
  UNION ALL SELECT 'total', 'sessions', count(DISTINCT session_id) FROM tel UNION ALL SELECT 'total', 'sources', count(DISTINCT source_id) FROM tel UNION ALL SELECT 'total', 'commands', count(*) FILTER (is_cmd) FROM tel""",
)
def report_counters(spark, sf_dir):
    return workspace.report_counters(telemetry(spark, sf_dir))


def _fixtures(spark, sf_dir):
    """A fixture for each event, as JSON; by seq % 12: 1 broken, 2 without event, 3 two engines, 4 the id before it, 5 an expectation that doesn't hold, 6 no id."""
    t = telemetry(spark, sf_dir, spread=True)
    found = detection.predictions(t, read_pack(PACK)).groupBy("event_id").agg(*(F.array_sort(F.collect_set(F.when(F.lower("engine") == e, F.col("rule_id")))).alias(e) for e in cases.ENGINES))
    m = F.col("seq") % 12
    case_id = F.when(m == 6, F.lit(None).cast("string")).when(m == 4, F.concat(F.lit("evt-"), (F.col("seq") - 1).cast("string"))).otherwise(F.col("event_id"))
    one = t.select("event_id", "seq", "sensor_id", "event_type", "protocol", F.struct("operation", "function_code", "signature").alias("decoded")).join(found, "event_id", "left")
    expected = F.struct(*(F.when((m == 3) & F.lit(e == "sigma"), F.lit(None).cast("array<string>")).when((m == 5) & F.lit(e == "wazuh"), F.array(F.lit("110101"), F.lit("999"))).otherwise(F.coalesce(e, F.array().cast("array<string>"))).alias(e) for e in cases.ENGINES))
    text = F.to_json(F.struct(case_id.alias("case_id"), F.when(m != 2, F.struct("sensor_id", "event_type", "protocol", "decoded")).alias("event"), expected.alias("expected")))
    return one.select(F.lit("fixtures").alias("file"), F.col("seq").alias("line_no"), F.when(m == 1, F.substring(text, 1, 9)).otherwise(text).alias("value"))


@query("fixture_errors", T + "SELECT seq AS line_no, CASE seq % 12 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'event_not_object' WHEN 3 THEN 'expected_engines' WHEN 4 THEN 'duplicate_case_id' ELSE 'case_id_missing' END AS code FROM raw WHERE seq % 12 IN (1, 2, 3, 4, 6)")
def fixture_errors(spark, sf_dir):
    return cases.fixture_errors(_fixtures(spark, sf_dir)).select("line_no", "code")


@query("pack_findings", T + "SELECT 'mismatch' AS code, count(*) AS n FROM raw WHERE seq % 12 = 5 UNION ALL SELECT code, count(*) FROM (SELECT CASE seq % 12 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'event_not_object' WHEN 3 THEN 'expected_engines' WHEN 4 THEN 'duplicate_case_id' ELSE 'case_id_missing' END AS code FROM raw WHERE seq % 12 IN (1, 2, 3, 4, 6)) GROUP BY 1 UNION ALL SELECT 'unknown_rule', 1")
def pack_findings(spark, sf_dir):
    """Everything wrong with the rule pack's fixtures; cases whose id or engines are at fault aren't matched by id here."""
    # made once: the checks read the lines many times over
    path = f"{work_dir(spark)}/fixtures"
    _fixtures(spark, sf_dir).write.parquet(path)
    lines = spark.read.parquet(path)
    found = cases.pack_findings(lines.where("line_no % 12 not in (3, 4, 6)"), read_pack(PACK)).where("code <> 'no_positive_case'")
    rest = cases.fixture_errors(lines).where("code in ('expected_engines', 'duplicate_case_id', 'case_id_missing')").select("code", F.lit("").alias("subject"))
    return found.unionByName(rest).groupBy("code").agg(F.count("*").alias("n"))


@query("verified_alerts", T + "SELECT s AS signature_id, count(seq) AS alerts, count(*) FILTER (seq % 10 = 0) AS misdirected FROM (SELECT unnest([4210501, 4210503, 9]) AS s) LEFT JOIN raw ON s = CASE WHEN protocol = 'modbus' AND starts_with(operation, 'write_') THEN 4210501 ELSE 4210503 END GROUP BY 1")
def verified_alerts(spark, sf_dir):
    """EVE alerts made of the telemetry: counted by signature, also one that never fires."""
    t = telemetry(spark, sf_dir)
    sid = F.when((F.col("protocol") == "modbus") & F.col("operation").startswith("write_"), 4210501).otherwise(4210503)
    eve = F.to_json(F.struct(F.lit("alert").alias("event_type"), F.struct(sid.alias("signature_id")).alias("alert"), F.when(F.col("seq") % 10 != 0, 502).otherwise(80).alias("dest_port")))
    other = t.limit(1).select(F.lit('{"event_type":"flow"}').alias("value"))
    return cases.verified_alerts(t.select(eve.alias("value")).unionByName(other), [4210501, 4210503, 9])


_CASE = lambda texts: "CASE priority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


@query("review_steps", T + f"SELECT event_id, {_CASE(C.NEXT_STEPS)} AS next_step, {_CASE(C.NOTES)} AS note FROM tel")
def review_steps(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", enrich.next_step(F.col("priority")).alias("next_step"), enrich.analyst_note(F.col("priority")).alias("note"))


@query(
    "foreign_events",
    T + """, f AS (SELECT event_id, seq % 5 AS m, source_ip, 40000 + seq % 1000 AS port, protocol, operation, observed_epoch FROM raw), e AS (SELECT *, CASE m WHEN 3 THEN '0.0.0.0' WHEN 2 THEN '2001:db8::5' ELSE source_ip END AS ip, CASE WHEN m IN (0, 1) THEN port WHEN m = 4 THEN port ELSE 0 END AS own_port FROM f)
SELECT event_id, ip AS source_ip, own_port::int AS source_port, protocol, CASE WHEN m IN (0, 1, 4) THEN 'protocol_request' ELSE 'connection' END AS event_type, substr(sha256('foreign-01|' || ip || '|' || own_port || '|' || observed_epoch), 1, 16) AS session_id, CASE WHEN m NOT IN (0, 1, 4) THEN 'info' WHEN m = 4 THEN 'info' WHEN operation IN ('write_single', 'write_multiple', 'single_command', 'setpoint_command', 'program_download') THEN 'high' ELSE 'info' END AS severity FROM e""",
)
def foreign_events(spark, sf_dir):
    """Logs of another decoy by seq % 5: 0 a list, 1 ip:port, 2 an IPv6 text without a request, 3 no address and an empty request, 4 src_ip with a text for a request."""
    t = raw_telemetry(spark, sf_dir)
    m, port = F.col("seq") % 5, (F.lit(40000) + F.col("seq") % 1000).cast("int")
    remote = F.when(m == 0, F.concat(F.lit('"remote":["'), "source_ip", F.lit('",'), port.cast("string"), F.lit("],"))).when(m == 1, F.concat(F.lit('"remote":"'), "source_ip", F.lit(":"), port.cast("string"), F.lit('",'))).when(m == 2, '"remote":"2001:db8::5",').when(m == 3, '"remote":"",').otherwise(F.concat(F.lit('"src_ip":"'), "source_ip", F.lit('","src_port":'), port.cast("string"), F.lit(",")))
    request = F.when(m == 2, "").when(m == 3, '"request":{},').when(m == 4, '"request":"text",').otherwise(F.concat(F.lit('"request":{"operation":"'), "operation", F.lit('"},')))
    line = F.concat(F.lit('{"event_id":"'), "event_id", F.lit('",'), remote, request, F.lit('"timestamp":"'), F.col("observed_epoch").cast("string"), F.lit('","protocol":"'), F.upper("protocol"), F.lit('"}'))
    return foreign.normalise_foreign(t.select(line.alias("value")), "foreign-01").select("event_id", "source_ip", "source_port", "protocol", "event_type", "session_id", "severity")


@query("canonical_digests", T + """SELECT event_id, sha256('{"a":{"k":' || k || '.5,"t":"\\u00e9"},"event_id":"' || event_id || '","z":[1,null,true]}') AS digest FROM raw""")
def canonical_digests(spark, sf_dir):
    """Digests of records in canonical form: sorted names, no spaces, ASCII alone."""
    text = F.concat(F.lit('{ "z": [1, null, true], "event_id": "'), "event_id", F.lit('", "a": {"t": "é", "k": '), F.col("k").cast("string"), F.lit(".50}}"))
    return raw_telemetry(spark, sf_dir).select("event_id", jsonl.canonical_digest(text).alias("digest"))


@query("network_prefixes", T + "SELECT event_id, CASE seq % 3 WHEN 0 THEN '192.0.2.0/24' WHEN 1 THEN '2001:db8:' || lower(to_hex(seq % 4096 + 1)) || '::/48' END AS network FROM raw")
def network_prefixes(spark, sf_dir):
    """The coarse network of addresses of both versions; null for other text."""
    t = raw_telemetry(spark, sf_dir)
    ip = F.when(F.col("seq") % 3 == 0, F.col("source_ip")).when(F.col("seq") % 3 == 1, F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("seq") % 4096 + 1)), F.lit(":7::9"))).otherwise("none")
    return t.select("event_id", foreign.network_of(ip).alias("network"))

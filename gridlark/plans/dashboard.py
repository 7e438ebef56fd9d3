"""Queries of the analyst's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import enrich
from gridlark.operators import geometry, views
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, VIEW_CONTROLS_SQL, telemetry

T = TELEMETRY_SQL

POINTS = f"""
SELECT source_id AS source, coalesce(source_country, 'Unknown') AS country, protocol, round_even(median(source_latitude) * 10, 0) / 10 AS latitude, round_even(median(source_longitude) * 10, 0) / 10 AS longitude,
  count(*) AS events, count(DISTINCT session_id) AS sessions, min(observed_epoch) AS first_seen, max(observed_epoch) AS last_seen,
  CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS max_severity,
  CAST(count(*) FILTER (operation IN ({VIEW_CONTROLS_SQL})) AS bigint) AS control_attempts, max(triage_score) AS public_review_score,
  coalesce(nullif(array_to_string(list_sort(list_distinct(flatten(list(technique_ids)))), ', '), ''), 'None') AS techniques
FROM tel WHERE plotted GROUP BY ALL
"""
# GROUP BY ALL groups by the three key expressions only: the rest are aggregates
PLAYBACK = """
SELECT observed_epoch // 21600 * 21600 AS time_bucket, source_id AS source, coalesce(source_country, 'Unknown') AS country, protocol,
  round_even(source_latitude * 10, 0) / 10 AS latitude, round_even(source_longitude * 10, 0) / 10 AS longitude, count(*) AS events
FROM tel WHERE plotted GROUP BY ALL
"""


@query("map_points", T + POINTS)
def map_points(spark, sf_dir):
    return views.map_points(telemetry(spark, sf_dir))


@query("map_quality", T + "SELECT count(*) AS events, count(*) FILTER (plotted) AS plotted_events, count(*) FILTER (NOT plotted) AS unmapped_events, count(DISTINCT source_country) FILTER (plotted) AS countries FROM tel")
def map_quality(spark, sf_dir):
    return views.map_quality(telemetry(spark, sf_dir))


_METRICS = f"""
, edge AS (SELECT max(observed_epoch) AS e FROM tel), cur AS (SELECT * FROM tel WHERE observed_epoch >= (SELECT e FROM edge) - 604800), prev AS (SELECT * FROM tel WHERE observed_epoch >= (SELECT e FROM edge) - 1209600 AND observed_epoch < (SELECT e FROM edge) - 604800)
, m AS (
  SELECT 'Events' AS metric, (SELECT count(*) FROM cur) AS current_window, (SELECT count(*) FROM prev) AS previous_window
  UNION ALL SELECT 'Sessions', (SELECT count(DISTINCT session_id) FROM cur), (SELECT count(DISTINCT session_id) FROM prev)
  UNION ALL SELECT 'Control actions', (SELECT count(*) FROM cur WHERE operation IN ({VIEW_CONTROLS_SQL})), (SELECT count(*) FROM prev WHERE operation IN ({VIEW_CONTROLS_SQL}))
  UNION ALL SELECT 'Mapped sources', (SELECT count(DISTINCT source_id) FROM cur WHERE plotted), (SELECT count(DISTINCT source_id) FROM prev WHERE plotted)
) SELECT metric, current_window, previous_window, current_window - previous_window AS change FROM m
"""


@query("window_comparison_7d", T + _METRICS)
def window_comparison_7d(spark, sf_dir):
    return views.window_comparison(telemetry(spark, sf_dir), 7)


@query("source_comparison", T + f"SELECT source, country, protocol, events, sessions, control_attempts, public_review_score, last_seen AS latest_observation, techniques FROM ({POINTS})")
def source_comparison(spark, sf_dir):
    return views.source_comparison(views.map_points(telemetry(spark, sf_dir)))


@query("flow_paths", T + f"SELECT * FROM ({POINTS}) ORDER BY events DESC, last_seen DESC NULLS LAST, source, protocol LIMIT 60")
def flow_paths(spark, sf_dir):
    return views.flow_paths(views.map_points(telemetry(spark, sf_dir)))


@query("standout_point", T + f"SELECT * FROM ({POINTS}) ORDER BY events DESC, public_review_score DESC, country, source, protocol LIMIT 1")
def standout_point(spark, sf_dir):
    return views.standout_point(views.map_points(telemetry(spark, sf_dir)))


@query("playback_6h", T + PLAYBACK)
def playback_6h(spark, sf_dir):
    return views.playback(telemetry(spark, sf_dir))


_GRID = f"""
, pb AS ({PLAYBACK}), grid AS (
  SELECT * FROM pb UNION ALL
  SELECT b.time_bucket, 'No observation', 'No observation in this window', p.protocol, 0.0, 0.0, 0 FROM (SELECT DISTINCT time_bucket FROM pb) b, (SELECT DISTINCT protocol FROM pb) p
  WHERE NOT EXISTS (SELECT 1 FROM pb x WHERE x.time_bucket = b.time_bucket AND x.protocol = p.protocol)
)
"""


@query("playback_grid", T + _GRID + "SELECT time_bucket, source, country, protocol, latitude, longitude, events FROM grid")
def playback_grid(spark, sf_dir):
    return views.playback_grid(views.playback(telemetry(spark, sf_dir)))


@query(
    "playback_enriched",
    T + _GRID + f", pts AS ({POINTS}) SELECT g.source, g.country, g.protocol, time_bucket, g.latitude, g.longitude, g.events, coalesce(p.events, 0) AS visible_events, coalesce(p.sessions, 0) AS sessions, coalesce(max_severity, 'info') AS max_severity, coalesce(control_attempts, 0) AS control_attempts, coalesce(techniques, 'None') AS techniques FROM grid g LEFT JOIN pts p USING (source, country, protocol)",
)
def playback_enriched(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return views.playback_enriched(views.playback_grid(views.playback(t)), views.map_points(t))


@query(
    "activity_cadence_6h",
    T + ", c AS (SELECT protocol, observed_epoch // 21600 * 21600 AS b, count(*) AS n FROM tel GROUP BY ALL), f AS (SELECT protocol, unnest(range(min(b), max(b) + 1, 21600)) AS time_bucket FROM c GROUP BY protocol) SELECT f.protocol, time_bucket, coalesce(n, 0) AS events FROM f LEFT JOIN c ON f.protocol = c.protocol AND f.time_bucket = c.b",
)
def activity_cadence_6h(spark, sf_dir):
    return views.cadence(telemetry(spark, sf_dir))


@query("geo_concentration", T + "SELECT coalesce(source_country, 'Unknown') AS country, count(*) AS events, count(DISTINCT session_id) AS sessions FROM tel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def geo_concentration(spark, sf_dir):
    return views.geo_concentration(telemetry(spark, sf_dir))


def _catalog_sql() -> str:
    from gridlark.functions.catalog import TECHNIQUES

    return ", catalog(technique_id, technique_name, tactic) AS (VALUES " + ", ".join(f"('{k}', '{n}', '{t}')" for k, (n, t) in TECHNIQUES.items()) + "), ex AS (SELECT *, unnest(technique_ids) AS tid FROM tel)"


CATALOG = _catalog_sql()


@query("technique_cards", T + CATALOG + " SELECT technique_id, technique_name, tactic, count(*) AS events FROM ex JOIN catalog ON tid = technique_id GROUP BY ALL ORDER BY events DESC, technique_id LIMIT 6")
def technique_cards(spark, sf_dir):
    return views.technique_cards(telemetry(spark, sf_dir))


@query("technique_protocol_matrix", T + CATALOG + " SELECT technique_id || ' ' || technique_name AS label, count(*) FILTER (protocol = 'modbus') AS modbus, count(*) FILTER (protocol = 's7') AS s7, count(*) FILTER (protocol = 'iec104') AS iec104 FROM ex JOIN catalog ON tid = technique_id GROUP BY 1")
def technique_protocol_matrix(spark, sf_dir):
    return views.technique_protocol_matrix(telemetry(spark, sf_dir))


@query("protocol_distribution", T + "SELECT protocol, count(*) AS events, CAST(round_even(100.0::double * count(*) / (SELECT count(*) FROM tel), 0) AS int) AS percent FROM tel GROUP BY protocol")
def protocol_distribution(spark, sf_dir):
    return views.protocol_distribution(telemetry(spark, sf_dir))


SPEC = views.FilterSpec(protocols=["modbus", "iec104"], severities=["high", "medium"], confidences=["high"], priorities=["urgent review", "high review", "elevated review"], control_only=True)
_FILTER = f"protocol IN ('modbus', 'iec104') AND severity IN ('high', 'medium') AND confidence = 'high' AND priority IN ('urgent review', 'high review', 'elevated review') AND operation IN ({VIEW_CONTROLS_SQL})"


@query("dashboard_filter", T + f"SELECT event_id, protocol, severity, priority, operation, source_country FROM tel WHERE {_FILTER}")
def dashboard_filter(spark, sf_dir):
    return views.dashboard_filter(telemetry(spark, sf_dir), SPEC).select("event_id", "protocol", "severity", "priority", "operation", "source_country")


@query("filter_options", T + "SELECT DISTINCT field, value FROM (SELECT unnest(['protocol', 'severity', 'source_country', 'priority']) AS field, unnest([protocol, severity, source_country, priority]) AS value FROM tel) WHERE value IS NOT NULL")
def filter_options(spark, sf_dir):
    return views.filter_options(telemetry(spark, sf_dir), ["protocol", "severity", "source_country", "priority"])


@query("kpi_counts", T + f"SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT source_id) AS sources, count(*) FILTER (operation IN ({VIEW_CONTROLS_SQL})) AS control_operations, count(*) FILTER (severity = 'high') AS high_severity FROM tel")
def kpi_counts(spark, sf_dir):
    return views.kpi_counts(telemetry(spark, sf_dir))


@query("visible_semi_join", T + f"SELECT event_id, session_id, source_id FROM raw WHERE event_id IN (SELECT event_id FROM tel WHERE {_FILTER})")
def visible_semi_join(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return views.visible(t.select("event_id", "session_id", "source_id"), views.dashboard_filter(t, SPEC))


@query("window_24h", T + "SELECT event_id, observed_epoch FROM tel WHERE observed_epoch BETWEEN (SELECT max(observed_epoch) FROM tel) - 86400 AND (SELECT max(observed_epoch) FROM tel)")
def window_24h(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    end = views.last_seen(t)
    return views.time_window(t, None if end is None else end - views.DAY, end).select("event_id", "observed_epoch")


def _queue(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("evidence_factors", enrich.factor_summary(F.col("factors"))).withColumn("completeness_label", F.col("completeness.label"))
    return views.triage_queue(t)


_LABEL = "CASE WHEN checks_met = 4 THEN 'complete fields' WHEN checks_met <= 1 THEN 'limited fields' ELSE 'partial fields' END"
_QUEUE = f"SELECT event_id, session_id, seq, observed_epoch, source_id AS source, protocol, triage_score AS score, priority, factors AS evidence_factors, {_LABEL} AS completeness_label FROM tel"


@query("triage_queue", T + _QUEUE)
def triage_queue(spark, sf_dir):
    return _queue(spark, sf_dir)


@query(
    "session_triage_queue",
    T + f", q AS ({_QUEUE}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, observed_epoch DESC, seq DESC) AS rn FROM q) SELECT session_id, min(observed_epoch) AS first_seen, max(observed_epoch) AS last_seen, array_to_string(list_sort(list(DISTINCT source)), ', ') AS source, array_to_string(list_sort(list(DISTINCT protocol)), ', ') AS protocols, count(*) AS events, max(score) FILTER (rn = 1) AS highest_score, max(priority) FILTER (rn = 1) AS priority, count(*) FILTER (completeness_label <> 'complete fields') AS incomplete_events, max(evidence_factors) FILTER (rn = 1) AS top_evidence_factors FROM r GROUP BY session_id",
)
def session_triage_queue(spark, sf_dir):
    return views.session_queue(_queue(spark, sf_dir))


@query("priority_histogram", T + "SELECT priority, count(*) AS events, CAST(list_position(['urgent review', 'high review', 'elevated review', 'routine review', 'informational'], priority) AS int) AS place FROM tel GROUP BY priority")
def priority_histogram(spark, sf_dir):
    return views.priority_histogram(_queue(spark, sf_dir))


@query("investigation_lead", T + f"SELECT * FROM ({_QUEUE}) ORDER BY score DESC, observed_epoch DESC, seq DESC LIMIT 1")
def investigation_lead(spark, sf_dir):
    return _queue(spark, sf_dir).limit(1)


@query("marker_geometry", T + f"SELECT source, country, protocol, round(least(28.0, 6 + 2.4 * sqrt(greatest(events, 1))), 6) AS marker_size, round(least(4.5, 1.1 + 0.68 * ln(1 + events)), 6) AS line_width FROM ({POINTS})")
def marker_geometry(spark, sf_dir):
    return geometry.marker_geometry(views.map_points(telemetry(spark, sf_dir)))


_ARC = """
, p AS (SELECT source, country, protocol, radians(latitude) AS a1, radians(longitude) AS o1, radians(24.4) AS a2, radians(54.4) AS o2 FROM pts), d AS (
  SELECT *, acos(greatest(-1.0, least(1.0, sin(a1) * sin(a2) + cos(a1) * cos(a2) * cos(o1 - o2)))) AS w FROM p), s AS (SELECT *, unnest(range(28)) AS step FROM d), f AS (
  SELECT *, sin((1 - step / 27.0::double) * w) / sin(w) AS fa, sin(step / 27.0::double * w) / sin(w) AS fb FROM s WHERE w > 1e-6), xyz AS (
  SELECT source, country, protocol, step, fa * cos(a1) * cos(o1) + fb * cos(a2) * cos(o2) AS x, fa * cos(a1) * sin(o1) + fb * cos(a2) * sin(o2) AS y, fa * sin(a1) + fb * sin(a2) AS z FROM f)
SELECT source, country, protocol, CAST(step AS int) AS step, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS latitude, round(degrees(atan2(y, x)), 5) AS longitude FROM xyz
"""


@query("great_circle", T + f", pts AS ({POINTS})" + _ARC)
def great_circle(spark, sf_dir):
    return geometry.great_circles(views.map_points(telemetry(spark, sf_dir)))


@query("map_viewpoint", T + f", pts AS ({POINTS}), s AS (SELECT greatest(max(latitude) - min(latitude), max(longitude) - min(longitude), 20.0) AS span, median(latitude) AS latitude, median(longitude) AS longitude FROM pts) SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(least(2.8, greatest(0.75, 2.8 - log2(span / 20))), 6) AS zoom FROM s")
def map_viewpoint(spark, sf_dir):
    return geometry.viewpoint(views.map_points(telemetry(spark, sf_dir)))

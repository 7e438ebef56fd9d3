"""Small texts over the observation index: the weekly report, the Navigator layer, the public summary.

Each is built from aggregates whose rows are bounded by the catalog or by a top five; names that data brings are counted, not picked from
a list.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.operators import index

SUMMARY_VERSION = "gridlark-public-summary-1.0"
#: Protocols that a report always lists, in this order; others follow by name.
REPORT_PROTOCOLS = ("modbus", "s7", "iec104")


def protocol_counts(idx: DataFrame) -> DataFrame:
    """Events of every protocol, those of the fixed list even at zero."""
    fixed = idx.sparkSession.createDataFrame([(p, 0) for p in REPORT_PROTOCOLS], "protocol string, events long")
    return idx.select(F.coalesce("protocol", F.lit("unknown")).alias("protocol"), F.col("repeat_count").cast("long").alias("events")).unionByName(fixed).groupBy("protocol").agg(F.sum("events").alias("events"))


def ranked_sources(idx: DataFrame, top: int = 5) -> DataFrame:
    """Sources with the most sessions; one without a named session isn't ranked."""
    return index.report_top_sources(idx.where(F.coalesce(F.col("session_id"), F.lit("")) != ""), top)


def weekly_text(idx: DataFrame, as_of: datetime, days: int = 7) -> str:
    """A report in Markdown over observations last seen in [as_of - days, as_of). Synthetic and observed rows must not be mixed."""
    days, end = max(1, min(90, days)), as_of.astimezone(UTC)
    seen = index.report_window(idx, int(end.timestamp()), days)
    classes = seen.agg(F.bool_or("is_demo").alias("some"), F.bool_and("is_demo").alias("every")).first()
    if classes.some is not None and classes.some != classes.every:
        raise ValueError("synthetic and observed records must not be mixed in one report")
    total = index.report_totals(seen).first()
    protocols = {r.protocol: r.events for r in protocol_counts(seen).collect()}
    techniques = index.technique_totals(seen).groupBy("technique_id").agg(F.sum("total").alias("events"), F.array_join(F.array_sort(F.collect_list(F.concat("confidence", F.lit(": "), F.col("total").cast("string")))), ", ").alias("confidences"))
    techniques = [(r.technique_id, r.events, r.confidences) for r in techniques.orderBy(F.desc("events"), "technique_id").limit(5).collect()]
    sources = [(r.source_id, r.sessions) for r in ranked_sources(seen).collect()]
    order = [*REPORT_PROTOCOLS, *sorted(set(protocols) - set(REPORT_PROTOCOLS))]
    row = lambda *cells: "| " + " | ".join(map(str, cells)) + " |"
    notice = "synthetic data, nothing of it was observed" if classes.every in (None, True) else "private sanitised observations, not cleared for release"
    return "\n".join(
        [
            "# Weekly telemetry report", "", f"> Notice: {notice}.", "", f"Window: {(end - timedelta(days=days)).isoformat(timespec='seconds')} to {end.isoformat(timespec='seconds')} (UTC), end excluded.", "",
            f"- Sessions: {total.sessions}", f"- Events with repeats: {total.events}", "", "## Protocols", "", row("Protocol", "Events"), row("-", "-:"), *(row(p, protocols.get(p, 0)) for p in order), "",
            "## Techniques", "", row("Technique", "Events", "By confidence"), row("-", "-:", "-"), *(row(*t) for t in techniques or [("None", 0, "nothing was mapped in the window")]), "",
            "## Sources", "", row("Pseudonym", "Sessions"), row("-", "-:"), *(row(*s) for s in sources or [("None", 0)]), "",
            "Repeats inside the merge window count through `repeat_count`. Mappings are hypotheses; a source is no person.", "",
        ]
    )


def layer(idx: DataFrame) -> dict:
    """A Navigator layer of technique scores; a technique outside the catalog is an error."""
    rows = index.navigator_layer(idx.where(F.size("techniques") > 0)).orderBy("technique_id").collect()
    if odd := [r.technique_id for r in rows if r.technique_id not in C.TECHNIQUES]:
        raise ValueError(f"techniques outside the catalog: {', '.join(map(str, odd[:10]))}")
    techniques = [{"techniqueID": r.technique_id, "score": r.score, "comment": f"{r.score} observations; confidence: {r.confidences}", "enabled": True} for r in rows]
    return {
        "name": "Technique frequency", "description": "How often observations hint at a technique; no proof of compromise.", "versions": {"attack": "18", "navigator": "5.3.2", "layer": "4.5"}, "domain": "ics-attack", "sorting": 3, "hideDisabled": False,
        "techniques": techniques, "gradient": {"colors": ["#eef4ee", "#7fae86", "#1d4d2b"], "minValue": 0, "maxValue": max((r.score for r in rows), default=1)},
    }


def name_counts(events: DataFrame) -> DataFrame:
    """(counter, name, n) of every protocol, event type, severity and technique that occurs."""
    own = [F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for c in ("protocol", "event_type", "severity")]
    technique = F.transform(F.coalesce("technique_ids", F.array()), lambda t: F.struct(F.lit("technique").alias("counter"), F.coalesce(t, F.lit("unknown")).alias("name")))
    return events.select(F.explode(F.concat(F.array(*own), technique)).alias("x")).groupBy("x.counter", "x.name").agg(F.count("*").alias("n"))


def summary(events: DataFrame) -> dict:
    """Aggregates alone, for publication after review."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    day = F.substring(F.col("observed_at").cast("string"), 1, 10)
    total = events.agg(F.count("*").alias("events"), F.countDistinct(filled("session_id")).alias("sessions"), F.countDistinct(filled("source_id")).alias("pseudonymous_sources"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.bool_and("is_demo").alias("demo")).first()
    counts: dict[str, dict[str, int]] = {c: {} for c in ("protocol", "event_type", "severity", "technique")}
    for r in name_counts(events).orderBy("counter", "name").collect():  # a row for each name
        counts[r.counter][r.name] = r.n
    return {
        "schema_version": SUMMARY_VERSION, "data_classification": "synthetic_demo" if total.demo else "sanitized_observations", "observation_window": {"first_date": total.first_date, "last_date": total.last_date},
        "totals": {"events": total.events, "sessions": total.sessions, "pseudonymous_sources": total.pseudonymous_sources}, "protocols": counts["protocol"], "event_types": counts["event_type"], "severities": counts["severity"], "techniques": counts["technique"],
    }

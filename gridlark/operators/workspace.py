"""An analyst's workspace: filters as a state that can be saved and replayed, focus and order of what is shown.

A saved state holds names and counts, no events. Its digest is of its filters, so that two people who saved the same view can tell, and a
state that was changed by hand is refused.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.operators import views

SNAPSHOT = "gridlark-view-snapshot.v1"
#: Presets of the time window, in days; None is open.
WINDOWS = {"All observations": None, "Last 24 hours": 1, "Last 7 days": 7, "Last 14 days": 14}
FILTERS = ("protocols", "severities", "countries", "confidences", "priorities")
SELECTION = ("source", "country", "protocol", "events", "sessions", "max_severity", "first_seen", "last_seen", "control_attempts", "techniques")
_COUNTS = ("events", "sessions", "control_attempts")
#: Orders of options that aren't alphabetic.
FIXED_ORDERS = {"severity": tuple(C.SEVERITY_RANK), "mapping_confidence": ("none", "low", "medium", "high"), "priority": C.PRIORITIES}


def safe_list(values) -> list[str]:
    """Different strings that aren't empty, in order; nothing for what is no list."""
    return sorted({str(v) for v in values if str(v)}) if isinstance(values, (list, tuple, set, frozenset)) else []


def safe_texts(values: Column) -> Column:
    """The same for a column of arrays."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.length(v) > 0)))


def safe_selection(value) -> dict | None:
    """A selected map point with its fields alone: counts are whole numbers from 0, others text; None where it names no point."""
    if not isinstance(value, dict) or not {"source", "country", "protocol"} <= value.keys():
        return None

    def count(item) -> int:
        try:
            return max(0, int(item))
        except (TypeError, ValueError):
            return 0

    return {name: count(value.get(name)) if name in _COUNTS else str(value.get(name) or "") for name in SELECTION}


def selection_of(points: DataFrame) -> DataFrame:
    """Map points as selections, column by column."""
    return points.select(*((F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))) if c in _COUNTS else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in SELECTION))


@dataclass(frozen=True)
class View:
    """What is filtered and selected. ``chosen`` maps names of ``FILTERS`` to values; a missing name leaves its field open."""

    chosen: dict[str, list[str]]
    control_only: bool = False
    window: str = "All observations"
    selection: dict | None = None

    def spec(self) -> views.FilterSpec:
        return views.FilterSpec(**{n: self.chosen.get(n) for n in FILTERS}, control_only=self.control_only)

    def apply(self, t: DataFrame) -> DataFrame:
        """The filtered events of the window; the window's end is the last filtered event."""
        shown = views.dashboard_filter(t, self.spec())
        if (days := WINDOWS[self.window]) is None:
            return shown
        end = views.last_seen(shown)
        return views.time_window(shown, None if end is None else end - days * views.DAY, end)

    def filters(self) -> dict:
        return {n: safe_list(self.chosen[n]) for n in FILTERS if n in self.chosen} | {"control_only": self.control_only, "window": self.window}

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.filters(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(t: DataFrame, view: View, is_demo: bool) -> dict:
    """Counts that go with a view, in one pass over its events; aggregates alone."""
    ok = views.valid_coordinates(F.col("source_latitude"), F.col("source_longitude"))
    one = view.apply(t).agg(
        F.count("*").alias("filtered_events"), F.count_if(ok).alias("mapped_events"), F.count_if(~ok).alias("excluded_events"), F.countDistinct(F.when(ok, views.text_or("source_id", "redacted"))).alias("mapped_sources"), F.countDistinct(F.when(ok, views.text_or("source_country", "Unknown"))).alias("mapped_countries"),
    ).first()
    return {"dataset_status": "synthetic" if is_demo else "sanitized", "filters": view.filters(), "filters_sha256": view.digest(), "aggregate_counts": one.asDict()}


def to_snapshot(t: DataFrame, view: View, is_demo: bool) -> str:
    """A view and its counts as JSON text."""
    return json.dumps({"schema_version": SNAPSHOT, "selection": safe_selection(view.selection)} | manifest(t, view, is_demo), sort_keys=True, separators=(",", ":"))


def from_snapshot(text: str) -> View:
    """The view of a snapshot; another version, an unknown window or filters that don't have their digest are errors."""
    saved = json.loads(text)
    if not isinstance(saved, dict) or saved.get("schema_version") != SNAPSHOT:
        raise ValueError("the snapshot's version is missing or not supported")
    filters = saved.get("filters")
    if not isinstance(filters, dict):
        raise TypeError("the snapshot holds no filters")
    if filters.get("window") not in WINDOWS:
        raise ValueError("the snapshot's window is not supported")
    view = View({n: safe_list(filters[n]) for n in FILTERS if n in filters}, filters.get("control_only") is True, filters["window"], safe_selection(saved.get("selection")))
    if view.digest() != saved.get("filters_sha256"):
        raise ValueError("the snapshot's filters were changed")
    return view


def custom_range(t: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Events of UTC days (yyyy-mm-dd), both included, whole."""
    from datetime import UTC, datetime

    at = lambda day: int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp())
    return t.where((F.col("observed_epoch") >= at(first_day)) & (F.col("observed_epoch") < at(last_day) + views.DAY))


def focused(t: DataFrame, technique: str | None = None, source: str | None = None, protocol: str | None = None) -> DataFrame:
    """Events with a technique, of a source, of a protocol; None leaves a field open, a null in a field never matches."""
    keep = F.lit(True)
    if technique is not None:
        keep &= F.coalesce(F.array_contains("technique_ids", technique), F.lit(False))
    for column, value in (("source_id", source), ("protocol", protocol)):
        if value is not None:
            keep &= F.coalesce(F.col(column) == value, F.lit(False))
    return t.where(keep)


def focused_predictions(found: DataFrame, engines: list[str] | None = None, protocols: list[str] | None = None, rule: str | None = None) -> DataFrame:
    keep = F.lit(True)
    for column, chosen in (("engine", engines), ("protocol", protocols), ("rule_id", None if rule is None else [rule])):
        if chosen is not None:
            keep &= F.coalesce(F.col(column).isin(*chosen), F.lit(False)) if chosen else F.lit(False)
    return found.where(keep)


def of_selected(t: DataFrame, selection: dict) -> DataFrame:
    """Events of a selected map point: source, protocol and country are compared as the point spells them."""
    key = {"source": views.text_or("source_id", "redacted"), "country": views.text_or("source_country", "Unknown"), "protocol": F.lower(views.text_or("protocol", "unknown"))}
    keep = F.lit(True)
    for name, c in key.items():
        keep &= c == selection[name]
    return t.where(keep)


def newest(t: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest events, with their place."""
    top = t.orderBy(F.desc("observed_epoch"), F.desc("seq")).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("observed_epoch"), F.desc("seq"))).cast("int"))  # over n rows


def recent_observations(t: DataFrame) -> DataFrame:
    return newest(t, 4)


def evidence_timeline(t: DataFrame) -> DataFrame:
    return newest(t, 20)


def session_ledger(t: DataFrame, session: str) -> DataFrame:
    """A session's events, the latest first; it is as long as the session."""
    return t.where(F.col("session_id") == session).orderBy(F.desc("observed_epoch"), F.desc("seq"))


def compared_sources(points: DataFrame, chosen: list[str] | None = None, most: int = 3) -> DataFrame:
    """Up to three source groups side by side: those named, else the first by score, events and name."""
    own = points if chosen is None else points.where(F.col("source").isin(*chosen[:most]) if chosen else F.lit(False))
    ranked = views.source_comparison(own)
    return ranked.limit(most) if chosen is None else ranked


def playback_order(grid: DataFrame) -> DataFrame:
    return grid.orderBy("time_bucket", "protocol", F.desc("events"), "source", "country")


def accessible_table(points: DataFrame) -> DataFrame:
    return points.orderBy(F.desc("events"), "source", "protocol", "country")


def leading_protocol(t: DataFrame) -> DataFrame:
    """The protocol with most events; the first by name of equals."""
    return t.groupBy("protocol").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "protocol").limit(1)


def most_common(t: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their place; of equals the one seen first."""
    by = t.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq")).orderBy(F.desc("events"), "first_seq").limit(n)
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("events"), "first_seq")).cast("int")).drop("first_seq")  # over n rows


def prediction_order(found: DataFrame) -> DataFrame:
    return found.orderBy("engine", "rule_id", "protocol", "event_id")


def ordered_options(t: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of fields with their place: a fixed order where there is one (values outside it follow), else by name. A field's options are few."""
    options = views.filter_options(t, columns)
    rank = F.lit(None).cast("int")
    for column, order in FIXED_ORDERS.items():
        at = F.array_position(F.array(*map(F.lit, order)), F.col("value")).cast("int")
        rank = F.when(F.col("field") == column, F.when(at > 0, at).otherwise(len(order) + 1)).otherwise(rank)
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.coalesce(rank, F.lit(0)), "value"))
    return options.withColumn("place", place.cast("int"))


def change_text(comparison: DataFrame) -> str:
    """The first two counts that changed between two windows, in words; a comparison has four rows."""
    rows = comparison.collect()
    if not rows:
        return "There are no windows to compare."
    said = []
    for r in (r for r in rows if r.change):
        if not r.previous_window:
            said.append(f"{r.metric}: {r.current_window:,} now, none before")
        else:
            said.append(f"{r.metric} {'up' if r.change > 0 else 'down'} by {abs(r.change):,} ({r.previous_window:,} to {r.current_window:,})")
    return "; ".join(said[:2]) + ". Counts of recorded windows; no rate or cause." if said else "No count changed between the windows."


def mapping_state(techniques: Column) -> Column:
    return F.when(F.coalesce(F.size(techniques), F.lit(0)) > 0, "mapped hypothesis").otherwise("no mapped technique")


def repeat_observations(events: Column, sessions: Column) -> Column:
    return F.greatest(F.lit(0), events - sessions)


def review_key(source: Column, country: Column, protocol: Column) -> Column:
    """A short name-free key of a source group for review notes."""
    return F.substring(F.sha2(F.concat_ws("|", source, country, protocol), 256), 1, 16)


def safe_iso(epoch: Column) -> Column:
    """UTC ISO text with an offset; null stays null."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def exact_medians(t: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): exact, the mean of the two middle values for even counts; nulls and NaN are left out, a null key is a key.

    Equal values are counted first. Running sums over a key's blocks of values (whole numbers) say which block holds the middle; only
    that block's values are put in order. So no task sorts a key's rows, however many there are.
    """
    v = F.col(value)
    counts = t.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, v.cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("block", F.floor("v"))
    blocks = counts.groupBy(*keys, "block").agg(F.sum("n").alias("m"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("m").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*keys, "block", "m", before.alias("before"), F.sum("m").over(own).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda at, start, size: (at >= start) & (at < start + size)
    middle = blocks.where(holds(low, F.col("before"), F.col("m")) | holds(high, F.col("before"), F.col("m")))
    middle = middle.select("before", "total", *(F.col(k).alias(f"__{k}") for k in (*keys, "block")))
    same = F.lit(True)
    for k in (*keys, "block"):
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = counts.join(middle, same)
    start = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.withColumn("start", start)
    pick = lambda at: F.max(F.when(holds(at, F.col("start"), F.col("n")), F.col("v")))
    return placed.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias("median"))


def focus_viewpoint(points: DataFrame, focus: dict | None) -> DataFrame:
    """Centre and zoom: the focused point where it is there, else over all points."""
    from gridlark.operators.geometry import viewpoint

    everything = viewpoint(points)
    if focus is None:
        return everything
    here = points.where((F.col("source") == focus["source"]) & (F.col("country") == focus["country"]) & (F.col("protocol") == focus["protocol"])).agg(F.max("latitude").alias("lat"), F.max("longitude").alias("lon"))
    both = everything.join(F.broadcast(here))  # a row each
    found = F.col("lat").isNotNull()
    return both.select(F.when(found, F.col("lat")).otherwise(F.col("latitude")).alias("latitude"), F.when(found, F.col("lon")).otherwise(F.col("longitude")).alias("longitude"), F.when(found, F.lit(3.6)).otherwise(F.col("zoom")).alias("zoom"))


def report_counters(t: DataFrame) -> DataFrame:
    """(counter, name, n) of a printed report: protocols, operations, techniques; sessions, sources and commands as totals."""
    own = [F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for c in ("protocol", "operation")]
    technique = F.transform(F.coalesce("technique_ids", F.array()), lambda x: F.struct(F.lit("technique").alias("counter"), x.alias("name")))
    names = t.select(F.explode(F.concat(F.array(*own), technique)).alias("x")).groupBy("x.counter", "x.name").agg(F.count("*").alias("n"))
    total = t.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("source_id").alias("sources"), F.count_if(F.col("operation").isin(*C.COMMANDS)).alias("commands"))
    totals = total.selectExpr("stack(3, 'sessions', sessions, 'sources', sources, 'commands', commands) AS (name, n)").select(F.lit("total").alias("counter"), "name", "n")
    return names.unionByName(totals)


def bar_length(share: Column) -> Column:
    """Cells of a text bar of 24: one at least."""
    return F.greatest(F.lit(1), F.bround(24 * share, 0).cast("int"))

"""The deduplicated observation index: ordinals, novelty, inactivity merge, idempotent import, reports."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions import catalog as C
from gridlark.functions import crypto
from gridlark.session import tasks

MIN_WINDOW, MAX_WINDOW = 60, 86_400


#: Arrival numbers of a block: a source's events are counted by block first, so none is ordered in one piece.
SEQ_BLOCK = 4096


def repeat_and_novelty(t: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``repeat_source_count``: the event's ordinal in its source; ``novel``: first of its key, ever. Order is arrival (seq).

    An ordinal is the number of the source's events in earlier blocks, from running sums over the small table
    of counts by block, and the place inside the block. The first of a key is a minimum, combined before the
    shuffle.
    """
    t = t.withColumn("block", F.floor(F.col("seq") / SEQ_BLOCK))
    counts = t.groupBy("source_id", "block").agg(F.count("*").alias("n"))
    before = counts.select("source_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("source_id", "block").orderBy("seq"))
    t = t.withColumn("place", place).join(before, ["source_id", "block"]).withColumn("repeat_source_count", (F.col("place") + F.col("before")).cast("int")).drop("place", "before", "block")
    first = t.groupBy(key).agg(F.min("seq").alias("first_seq"))
    return t.join(first, key).withColumn("novel", F.col("seq") == F.col("first_seq")).drop("first_seq")


def with_fingerprint(t: DataFrame, secret: bytes) -> DataFrame:
    return t.withColumn("fingerprint", crypto.fingerprint(F.col("source_ip"), F.col("protocol"), F.col("payload"), secret))


#: Events of a task, where their number is known: a task holds them several times, in different orders.
EVENTS_OF_TASK = 50_000


def merged_observations(t: DataFrame, window: int, keys: list[str] | None = None, events: int = 0) -> DataFrame:
    """Observations of a key at most ``window`` seconds apart become one (the border counts as inside), in order of arrival (seq).

    An event joins the merged row of its key whose last time is the latest one within ``window`` seconds before
    the event or at it, and moves that last time up; else it starts a row. A late event so never joins a row that is
    already beyond it. The first event of a row gives identity, session, severity and techniques.

    Arrivals fall into stretches: a cut is where all later times lie more than ``window`` after all earlier ones.
    Stretches with times in order are one row each, by aggregates alone; the others are folded, as sorted
    streams that hold one key's last times. ``events`` is their number, if known: keys are dealt to more tasks for more of them.
    """
    window = max(MIN_WINDOW, min(MAX_WINDOW, window))
    keys = keys or ["fingerprint"]
    names = [c for c in ("event_id", "session_id", "severity", "technique_ids", "techniques") if c in t.columns]
    # rows of a few columns compress well: merged by their shuffled size, a task would get many times that in memory
    t = t.select(*keys, "seq", "observed_epoch", *names).repartition(max(tasks(t.sparkSession), -(-events // EVENTS_OF_TASK)), *keys)
    order = W.partitionBy(*keys).orderBy("seq")
    high = F.max("observed_epoch").over(order.rowsBetween(W.unboundedPreceding, -1))
    # the least later time as a running minimum from the end: a frame that reaches forward to the end is worked out anew for every row
    low = F.min("observed_epoch").over(W.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0))
    marked = t.withColumn("low", low).withColumn("high", high)
    marked = marked.withColumn("stretch", F.sum(F.when(F.col("low") - F.col("high") > window, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    late = F.coalesce(F.bool_or(F.col("observed_epoch") < F.col("high")).over(W.partitionBy(*keys, "stretch")), F.lit(False))
    marked = marked.withColumn("late", late).drop("high")
    marked = marked.select(*keys, "seq", "observed_epoch", *names, "stretch", "late", "low")
    ordered = marked.where("not late").drop("late", "low").withColumn("part", F.lit(0).cast("bigint"))
    by = [*keys, "stretch", "part"]
    folded = _folded(marked.where("late").drop("late"), keys, window)
    first = lambda c: F.min_by(c, "seq").alias(c)
    rows = ordered.unionByName(folded).groupBy(*by).agg(F.min("seq").alias("first_seq"), F.min("observed_epoch").alias("first_seen"), F.max("observed_epoch").alias("last_seen"), F.count("*").alias("repeat_count"), *map(first, names))
    # merged rows of a key are numbered by arrival; there are far fewer of them than events
    return rows.withColumn("island", (F.row_number().over(W.partitionBy(*keys).orderBy("first_seq")) - 1).cast("bigint")).drop("stretch", "part")


def _folded(late: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Adds ``part``, the merged row of its stretch that an event joins, in place of ``low``, the least time still to come.

    The last times of rows that an event may still join are held in order; those more than ``window`` before ``low`` are dropped, so a
    stretch of any length holds the rows open at a time, and an event costs a binary search.
    """
    by = [*keys, "stretch"]
    # a key's rows are in one task already
    spread = late.sortWithinPartitions(*by, "seq")

    def fold(frames):
        at, lasts, rows, made = None, [], [], 0
        for pdf in frames:
            parts = []
            for key, t, low in zip(zip(*(pdf[c] for c in by)), pdf["observed_epoch"], pdf.pop("low")):
                if key != at:
                    at, lasts, rows, made = key, [], [], 0
                if gone := bisect_left(lasts, low - window):
                    del lasts[:gone], rows[:gone]
                # of equal last times the earliest row
                k = bisect_right(lasts, t) - 1
                if k >= 0 and lasts[k] >= t - window:
                    k = bisect_left(lasts, lasts[k])
                    row = rows[k]
                    del lasts[k], rows[k]
                else:
                    row = made
                    made += 1
                k = bisect_left(lasts, t)
                while k < len(lasts) and lasts[k] == t and rows[k] < row:
                    k += 1
                lasts.insert(k, t)
                rows.insert(k, row)
                parts.append(row)
            yield pdf.assign(part=parts)

    kept = [f for f in late.schema.fields if f.name != "low"]
    return spread.mapInPandas(fold, T.StructType([*kept, T.StructField("part", T.LongType())]))


def import_batch(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """New rows of ``incoming``: ids in the ledger with the same digest are skipped; another digest fails the whole batch."""
    both = incoming.join(ledger.select("event_id", F.col("digest").alias("known")), "event_id", "left")
    guard = F.when(F.col("known") != F.col("digest"), F.raise_error(F.lit("an event id came again with other content")).cast("boolean")).otherwise(F.col("known").isNull())
    return both.where(guard).drop("known")


def import_counts(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    both = incoming.join(ledger.select("event_id", F.col("digest").alias("known")), "event_id", "left")
    known = F.col("known").isNotNull()
    return both.agg(F.count("*").alias("accepted"), F.count_if(~known).alias("imported"), F.count_if(known & (F.col("known") == F.col("digest"))).alias("skipped"), F.count_if(known & (F.col("known") != F.col("digest"))).alias("conflicts"))


def technique_totals(index: DataFrame) -> DataFrame:
    """(technique_id, confidence) -> sum of repeats."""
    one = index.select("repeat_count", F.explode("techniques").alias("t"))
    return one.groupBy("t.technique_id", "t.confidence").agg(F.sum("repeat_count").alias("total"))


def navigator_layer(index: DataFrame) -> DataFrame:
    """Technique scores with their confidence counts as text, and the largest score."""
    by = technique_totals(index).groupBy("technique_id").agg(F.sum("total").alias("score"), F.array_join(F.array_sort(F.collect_list(F.concat("confidence", F.lit("="), F.col("total").cast("string")))), ", ").alias("confidences"))
    top = by.agg(F.coalesce(F.max("score"), F.lit(1)).alias("max_score"))
    return by.join(F.broadcast(top))


def report_window(index: DataFrame, end: int, days: int) -> DataFrame:
    """Observations last seen in the half-open window [end - days, end); days are clamped to 1..90."""
    days = max(1, min(90, days))
    return index.where((F.col("last_seen") >= end - days * 86_400) & (F.col("last_seen") < end))


def report_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.coalesce(F.sum("repeat_count"), F.lit(0)).alias("events"), F.countDistinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"))


def report_protocols(index: DataFrame) -> DataFrame:
    """Sum of repeats for each protocol of a fixed list, zeros included, in one pass."""
    sums = [F.coalesce(F.sum(F.when(F.col("protocol") == p, F.col("repeat_count"))), F.lit(0)).alias(p) for p in C.PROTOCOLS]
    rows = ", ".join(f"'{p}', {p}" for p in C.PROTOCOLS)
    return index.agg(*sums).selectExpr(f"stack({len(C.PROTOCOLS)}, {rows}) AS (protocol, events)")


def report_top_techniques(index: DataFrame, top: int = 5) -> DataFrame:
    """The most repeated techniques with the share of each confidence."""
    levels = [F.coalesce(F.sum(F.when(F.col("confidence") == c, F.col("total"))), F.lit(0)).alias(c) for c in ("high", "medium", "low")]
    return technique_totals(index).groupBy("technique_id").agg(F.sum("total").alias("events"), *levels).orderBy(F.desc("events"), "technique_id").limit(top)


def report_top_sources(index: DataFrame, top: int = 5) -> DataFrame:
    return index.groupBy("source_id").agg(F.countDistinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions")).orderBy(F.desc("sessions"), "source_id").limit(top)


def public_summary(t: DataFrame) -> DataFrame:
    """One row of totals, with counters as sorted ``name=count`` text, in one pass over the events."""

    def counter(column: Column, names) -> Column:
        parts = [F.when(F.count_if(column == n) > 0, F.concat(F.lit(f"{n}="), F.count_if(column == n).cast("string"))) for n in sorted(names)]
        return F.array_join(F.array_compact(F.array(*parts)), ", ")

    techniques = [F.when(F.count_if(F.array_contains("technique_ids", n)) > 0, F.concat(F.lit(f"{n}="), F.count_if(F.array_contains("technique_ids", n)).cast("string"))) for n in sorted(C.TECHNIQUES)]
    return t.agg(
        F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("source_id").alias("sources"), counter(F.col("protocol"), C.PROTOCOLS).alias("protocols"),
        counter(F.col("severity"), C.SEVERITY_RANK).alias("severities"), counter(F.col("event_type"), ("connection", "protocol_request", "session_error", "known_exploit_probe")).alias("event_types"),
        F.array_join(F.array_compact(F.array(*techniques)), ", ").alias("techniques"), F.substring(F.min(F.col("observed_at").cast("string")), 1, 10).alias("first_date"), F.substring(F.max(F.col("observed_at").cast("string")), 1, 10).alias("last_date"),
    )


def health_counters(t: DataFrame) -> DataFrame:
    """Totals by protocol and by event type: what a health snapshot counts."""
    kinds = F.explode(F.array(F.struct(F.lit("protocol").alias("counter"), F.col("protocol").alias("name")), F.struct(F.lit("event_type").alias("counter"), F.col("event_type").alias("name"))))
    return t.select(kinds.alias("x")).groupBy("x.counter", "x.name").agg(F.count("*").alias("n"))


def spool_admission(rows: DataFrame, max_rows: int, max_bytes: int, partition: str = "sensor_id") -> DataFrame:
    """Which arrivals a bounded spool admits when nothing is delivered meanwhile: running count and bytes by sensor."""
    w = W.partitionBy(partition).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("rank", F.count("*").over(w)).withColumn("held", F.sum("size").over(w)).withColumn("admitted", (F.col("rank") <= max_rows) & (F.col("held") <= max_bytes))

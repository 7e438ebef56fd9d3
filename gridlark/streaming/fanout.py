"""One stream, several tables: evidence first, what is derived from it after, each batch once in each.

Evidence is appended before anything else and never waits for a derived table. A derived table that fails keeps its place: the next batch,
or ``catch_up``, goes on from the first batch it lacks. Health counters are read from the committed evidence, so a batch that
comes again after a crash isn't counted twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.commits import Folder, Ledger, canonical_json


class FanOut:
    """``sinks`` are names with what makes their rows of a batch of evidence."""

    def __init__(self, spark: SparkSession, folder: str, sinks: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.files = spark, Folder(spark, folder)
        self.evidence = Ledger(spark, f"{self.files.path}/evidence")
        self.sinks = {name: (Ledger(spark, f"{self.files.path}/sink-{name}"), rows) for name, rows in sinks.items()}

    def each(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.evidence.append_once(batch, f"batch-{batch_id:012d}")
        self.catch_up()

    def catch_up(self) -> dict[str, int]:
        """Brings every sink up to the evidence; how many batches each still lacks."""
        batches, behind = sorted(self.evidence.committed()), {}
        for name, (ledger, rows) in self.sinks.items():
            done = ledger.committed()
            missing = [b for b in batches if b not in done]
            for k, b in enumerate(missing):
                try:
                    ledger.append_once(rows(self.evidence.rows_of(b)), b)
                except Exception as e:  # a sink's failure is noted, evidence and the other sinks go on
                    self.files.write_once(f"failures/{name}/{uuid.uuid4().hex}.json", canonical_json({"batch": b, "error": type(e).__name__}))
                    behind[name] = len(missing) - k
                    break
        return behind

    def failures(self) -> dict[str, int]:
        return {name: len(self.files.names(f"failures/{name}")) for name in self.sinks}

    def health(self) -> DataFrame:
        """One row: events, last time, counters as JSON text, failed deliveries, batches behind."""
        rows, behind = self.evidence.read(), {name: len(set(self.evidence.committed()) - set(ledger.committed())) for name, (ledger, _) in self.sinks.items()}
        facts = [F.lit(sum(self.failures().values())).cast("long").alias("delivery_failures"), F.lit(json.dumps(behind, sort_keys=True)).alias("behind")]
        if rows is None:
            return self.spark.range(1).select(F.lit(0).cast("long").alias("total_events"), F.lit(None).cast("string").alias("last_event_at"), F.lit("{}").alias("protocol_events"), F.lit("{}").alias("event_types"), *facts)
        one = lambda c: rows.groupBy(F.coalesce(c, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n"))))).alias(c))
        total = rows.agg(F.count("*").alias("total_events"), F.max(F.col("observed_at").cast("string")).alias("last_event_at"))
        joined = total.join(F.broadcast(one("protocol").withColumnRenamed("protocol", "protocol_events"))).join(F.broadcast(one("event_type").withColumnRenamed("event_type", "event_types")))  # a row each
        return joined.select("*", *facts)

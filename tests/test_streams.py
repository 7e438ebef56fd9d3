"""Keyed stream state against folds, and fan-out with failing sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridlark.plans.streams import drained
from gridlark.streaming import fanout, keyed

SECRET = b"synthetic-envelope-secret-000001"


def stream(spark, path, rows, schema, batches):
    """Rows in order, as so many files that were written one after another."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


@pytest.mark.parametrize("batches", [1, 5])
def test_ordinals_count_on(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(rng.choice(["a", "a", "b", None, "c"]), f"e{k}", k) for k in range(120)]
    rng.shuffle(rows[:20])
    known = spark.createDataFrame([("a", 7), ("z", 3)], "source_id string, n long")
    want, count = {}, {"a": 7}
    for source, event, seq in rows:
        count[source] = count.get(source, 0) + 1
        want[event] = count[source]
    s = stream(spark, tmp_path / "in", rows, "source_id string, event_id string, seq long", batches)
    assert {r.event_id: r.ordinal for r in drained(keyed.ordinals(s, "source_id", known), keyed_state=True).collect()} == want


@pytest.mark.parametrize("batches", [1, 4])
def test_reservations_end_by_time_or_release(spark, tmp_path, batches):
    rng = random.Random(3)
    rows, now = [], 1_700_000_000
    for k in range(160):
        now += rng.choice([0, 1, 30, 400, 950])
        rows.append((rng.choice(["s1", "s2"]), rng.choice(["e1", "e2", "e3"]), k, rng.choice(["reserve"] * 4 + ["release"]), now))
    want, until = [], {}
    for sensor, event, seq, kind, epoch in rows:
        if kind == "release":
            until.pop((sensor, event), None)
            continue
        free = until.get((sensor, event), 0) <= epoch
        if free:
            until[sensor, event] = epoch + 900
        want.append((sensor, event, seq, free))
    s = stream(spark, tmp_path / "in", rows, "sensor_id string, event_id string, seq long, kind string, epoch long", batches).withColumn("at", F.timestamp_seconds("epoch"))
    got = drained(keyed.reservations(s), keyed_state=True).select("sensor_id", "event_id", "seq", "accepted").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fan_out_keeps_evidence_and_catches_up(spark, tmp_path):
    schema = "event_id string, event_type string, protocol string, observed_at string"
    rows = [(f"e{k}", ("connection", "protocol_request")[k % 2], None if k == 3 else "s7", f"2024-01-01T00:00:{k:02d}") for k in range(12)]
    broken = [True]

    def flaky(batch):
        if broken:
            raise OSError("down")
        return batch.select("event_id")

    fan = fanout.FanOut(spark, f"file://{tmp_path}/out", {"good": lambda b: b.where("event_type = 'connection'"), "flaky": flaky})
    empty = fan.health().first()
    assert (empty.total_events, json.loads(empty.behind)) == (0, {"good": 0, "flaky": 0})
    s = stream(spark, tmp_path / "in", rows, schema, 3)
    run = lambda: s.writeStream.foreachBatch(fan.each).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    run()
    h = fan.health().first()
    assert (h.total_events, h.last_event_at, json.loads(h.protocol_events), json.loads(h.event_types)) == (12, "2024-01-01T00:00:11", {"s7": 11, "unknown": 1}, {"connection": 6, "protocol_request": 6})
    assert (h.delivery_failures, json.loads(h.behind)) == (3, {"good": 0, "flaky": 3}) and fan.sinks["good"][0].read().count() == 6
    broken.clear()
    assert fan.catch_up() == {} and fan.sinks["flaky"][0].read().count() == 12
    run()  # nothing new
    fan.each(spark.createDataFrame(rows[:4], schema), 0)  # a batch that comes again
    assert fan.health().first().total_events == 12 and json.loads(fan.health().first().behind) == {"good": 0, "flaky": 0}

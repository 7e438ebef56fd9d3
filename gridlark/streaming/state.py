"""Stateful streams: session merge, replay protection, alert suppression, envelope checks, device registers.

Each has a batch form over the same rows where one exists, and tests hold the two together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlark.functions import crypto

REPLAY_SECONDS, SUPPRESS_SECONDS, DEDUP_SECONDS = 900, 600, 1800
MAX_BODY_BYTES = 64 * 1024
#: Numbers of a block of ordered requests.
SEQ_BLOCK = 4096


def merged_sessions(events: DataFrame, gap_seconds: int = DEDUP_SECONDS, watermark: str | None = "1 hour") -> DataFrame:
    """Windows of a key that end after ``gap_seconds`` without an observation; works on streams and tables."""
    e = events.withWatermark("observed_at", watermark) if events.isStreaming and watermark else events
    window = F.session_window("observed_at", f"{gap_seconds} seconds")
    return e.groupBy("fingerprint", window.alias("w")).agg(F.count("*").alias("repeat_count"), F.max("observed_at").alias("last_seen")).select("fingerprint", F.col("w.start").alias("first_seen"), "last_seen", "repeat_count")


def without_replays(events: DataFrame, ttl_seconds: int = REPLAY_SECONDS) -> DataFrame:
    """The first arrival of each (sensor, event) within the time to live; expiry follows the watermark."""
    return events.withWatermark("received_at", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["sensor_id", "event_id"])


def suppression_fold(times: list[int], accepted: int | None, seconds: int) -> tuple[list[bool], int | None]:
    """Accept, then reject until ``seconds`` after the accepted one; a rejection doesn't slide the window."""
    out = []
    for t in times:
        ok = accepted is None or t - accepted >= seconds
        out.append(ok)
        if ok:
            accepted = t
    return out, accepted


def suppressed_alerts(alerts: DataFrame, seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """(alert_key, seq, epoch) -> sent flag, in order of arrival. State is one time for each key; keys idle out."""
    schema = "alert_key string, seq long, epoch long, sent boolean"

    if not alerts.isStreaming:
        # an alert that comes ``seconds`` after all before it is sent whatever was: its key is cut there, and the
        # stretches are folded as sorted streams
        order = Window.partitionBy("alert_key").orderBy("seq")
        high = F.max("epoch").over(order.rowsBetween(Window.unboundedPreceding, -1))
        cut = alerts.select("alert_key", "seq", "epoch", high.alias("high"))
        cut = cut.withColumn("stretch", F.sum(F.when(F.col("epoch") - F.col("high") >= seconds, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("high")

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, accepted = None, None
            for pdf in frames:
                sent = []
                for key, epoch in zip(zip(pdf["alert_key"], pdf["stretch"]), pdf["epoch"]):
                    if key != at:
                        at, accepted = key, None
                    (ok,), accepted = suppression_fold([epoch], accepted, seconds)
                    sent.append(ok)
                yield pdf.assign(sent=sent)[["alert_key", "seq", "epoch", "sent"]]

        return cut.repartition("alert_key", "stretch").sortWithinPartitions("alert_key", "stretch", "seq").mapInPandas(fold, schema)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values("seq")
        sent, accepted = suppression_fold(pdf["epoch"].tolist(), state.get[0] if state.exists else None, seconds)
        state.update((accepted,))
        state.setTimeoutDuration(seconds * 1000)
        yield pdf.assign(sent=sent)[["alert_key", "seq", "epoch", "sent"]]

    return alerts.select("alert_key", "seq", "epoch").groupBy("alert_key").applyInPandasWithState(step, schema, "accepted long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def alert_payloads(events: DataFrame, secret: bytes) -> DataFrame:
    """(event_id, payload): what may leave of high-severity events, as JSON text; the source is a keyed hash."""
    source_hash = F.substring(crypto.hmac_sha256(F.encode("source_ip", "UTF-8"), secret), 1, 24)
    payload = F.struct(F.lit("alert-1").alias("schema"), F.col("observed_at").cast("string").alias("observed_at"), "protocol", "severity", F.col("technique_ids"), source_hash.alias("source_hash"))
    return events.where(F.lower("severity") == "high").select("event_id", F.to_json(payload).alias("payload"))


def register_updates(requests: DataFrame, writable: tuple[int, int] = (0, 99)) -> DataFrame:
    """A simulated device's registers: ordered writes by sensor; refused outside ``writable``.

    A register's writes are sorted within blocks of ``SEQ_BLOCK`` numbers; each block's last value is carried to
    the next ones, so no task holds all writes of a sensor or a register.
    """
    low, high = writable
    ok = F.coalesce(F.col("address").between(low, high) & F.col("value").between(0, 0xFFFF), F.lit(False))
    r = requests.select("sensor_id", "seq", "address", "value", ok.alias("applied"), F.floor(F.col("seq") / SEQ_BLOCK).alias("block"))
    register = ["sensor_id", "address"]
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("applied"), F.col("value"))
    inside = r.withColumn("inside", F.last(written, ignorenulls=True).over(earlier([*register, "block"], "seq")))
    ends = r.where("applied").groupBy(*register, "block").agg(F.max_by("value", "seq").alias("end"))
    # every block of a register needs a row, also one without an applied write
    blocks = r.select(*register, "block").distinct().join(ends, [*register, "block"], "left")
    carried = blocks.withColumn("carried", F.last("end", ignorenulls=True).over(earlier(register, "block"))).where("carried is not null").drop("end")
    both = inside.join(carried, [*register, "block"], "left")
    previous = F.coalesce("inside", "carried", F.lit(0)).cast("int")
    return both.select("sensor_id", "seq", F.col("address").cast("int").alias("address"), previous.alias("previous"), F.col("value").cast("int").alias("value"), "applied")


def envelope_verdict(secrets: dict[str, bytes], now: Column, skew: int = 300, schema_name: str = "envelope-1") -> Column:
    """The first failed check of a signed envelope (columns sensor_id, timestamp, signature, body), null when all hold.

    Keys are few and configured; each sensor's keyed digest is one expression.
    """
    stamped = F.concat(F.encode(F.col("timestamp"), "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), F.encode("body", "UTF-8"))
    expected = F.lit(None).cast("string")
    for sensor, secret in secrets.items():
        expected = F.when(F.col("sensor_id") == sensor, crypto.hmac_sha256(stamped, secret)).otherwise(expected)
    sent = F.col("timestamp").try_cast("bigint")
    field = lambda path: F.get_json_object("body", path)
    same = field("$.sensor_id") == F.col("sensor_id")
    filled = F.lit(True)
    for name in ("event_id", "session_id", "protocol", "event_type", "observed_at"):
        filled &= F.length(F.coalesce(field(f"$.event.{name}"), F.lit(""))) > 0
    checks = [
        (F.octet_length("body") > MAX_BODY_BYTES, "body_too_large"),
        (~F.col("sensor_id").isin(*secrets), "unknown_sensor"),
        (sent.isNull(), "invalid_timestamp"),
        (F.abs(now - sent) > max(30, min(900, skew)), "timestamp_out_of_range"),
        (~(F.lower("signature") == expected), "invalid_signature"),
        (F.coalesce(F.try_parse_json("body").isNull(), F.lit(True)) | F.json_object_keys("body").isNull(), "invalid_json"),
        (~(field("$.schema") == schema_name), "unsupported_schema"),
        (~same, "sensor_mismatch"),
        (~filled, "missing_fields"),
    ]
    out = F.lit(None).cast("string")
    for bad, code in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), code).otherwise(out)
    return out


def envelope(sensor_id: str, event: dict, schema_name: str = "envelope-1") -> str:
    """The canonical body of an envelope, for tests and replays."""
    return json.dumps({"schema": schema_name, "sensor_id": sensor_id, "event": event}, sort_keys=True, separators=(",", ":"))

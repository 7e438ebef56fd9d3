"""Keyed state of streams: ordinals, novelty, suppression and replay keys, each equal to its batch form.

State of a key is one small value in the state store; where keys are many and short-lived, a bucket of keys (by hash) shares one value that holds
the live ones, so that a micro-batch costs a call for each bucket and not for each key. State may start from a table of what is known already. Within a micro-batch a
key's rows are put in order of arrival (seq); over micro-batches arrival order is the stream's. A micro-batch bounds what a key holds at
a time; give the source a limit for each trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.streaming.state import REPLAY_SECONDS, SUPPRESS_SECONDS, suppression_fold

#: Stateful processors need this state store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable")


class Ordinals(StatefulProcessor):
    """The number of each row of a key, counted on from the rows before the stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.count.update((int(initialState["n"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows)
        before = self.count.get()[0] if self.count.exists() else 0
        self.count.update((before + len(pdf),))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "ordinal": range(before + 1, before + len(pdf) + 1)})

    def close(self) -> None:
        pass


def ordinals(events: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(event_id, seq, ordinal) of a stream's rows by ``key``; ``known`` is (key, n) of rows that came before. A key's first row is its novel one."""
    start = known.select(key, "n").groupBy(key) if known is not None else None
    return events.select(key, "event_id", "seq").groupBy(key).transformWithStateInPandas(Ordinals(), "event_id string, seq long, ordinal long", "Append", "None", initialState=start)


class BucketState(StatefulProcessor):
    """Times by key for a bucket of keys: each is held until the watermark has passed it, and a bucket without any is cleared by its timer."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "keys array<string>, until array<bigint>, timer bigint")

    def fold(self, pdf: pd.DataFrame, until: dict[str, int]) -> pd.DataFrame:
        """The output of rows in order; ``until`` is changed."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, times, timer = self.held.get() if self.held.exists() else ([], [], None)
        until = dict(zip(keys, times))
        out = self.fold(_ordered(rows), until)
        self._put({k: t for k, t in until.items() if t * 1000 > timerValues.getCurrentWatermarkInMs()}, timer)
        yield out

    def _put(self, until: dict[str, int], timer: int | None) -> None:
        due = max(until.values()) * 1000 if until else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.held.clear()
            return
        self.held.update((list(until), [int(t) for t in until.values()], int(due)))
        if timer != due:
            self.handle.registerTimer(int(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # nothing that is still to come is so early that a key of this bucket would matter to it
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Buckets of keys.
BUCKETS = 1024


def _bucket(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).alias("bucket")


class Suppression(BucketState):
    """Sent unless one of the key was sent less than ``seconds`` before; the time last sent goes when the watermark has passed its window."""

    def fold(self, pdf: pd.DataFrame, until: dict[str, int]) -> pd.DataFrame:
        sent = []
        for key, epoch in zip(pdf["alert_key"].tolist(), pdf["epoch"].tolist()):
            before = until.get(key)
            (ok,), last = suppression_fold([epoch], None if before is None else before - self.seconds, self.seconds)
            until[key] = last + self.seconds
            sent.append(ok)
        return pdf[["alert_key", "seq", "epoch"]].assign(sent=sent)


def suppressed(alerts: DataFrame, seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """(alert_key, seq, epoch, sent) of a stream of (alert_key, seq, epoch, at); ``at`` carries the watermark."""
    held = alerts.select(_bucket("alert_key"), "alert_key", "seq", "epoch", "at").withWatermark("at", f"{seconds} seconds")
    return held.groupBy("bucket").transformWithStateInPandas(Suppression(seconds), "alert_key string, seq long, epoch long, sent boolean", "Append", "EventTime")


class ReplayKeys(BucketState):
    """A key is reserved until its time is over or it is released; until then other reservations of it are refused."""

    def fold(self, pdf: pd.DataFrame, until: dict[str, int]) -> pd.DataFrame:
        free = []
        for key, kind, epoch in zip(pdf["key"].tolist(), pdf["kind"].tolist(), pdf["epoch"].tolist()):
            if kind == "release":
                until.pop(key, None)
                free.append(False)
                continue
            ok = key not in until or until[key] <= epoch
            if ok:
                until[key] = epoch + self.seconds
            free.append(ok)
        return pdf.assign(accepted=free).loc[pdf["kind"] != "release", ["sensor_id", "event_id", "seq", "accepted"]]


def reservations(requests: DataFrame, seconds: int = REPLAY_SECONDS) -> DataFrame:
    """(sensor_id, event_id, seq, accepted) of a stream of (sensor_id, event_id, seq, kind, epoch, at); kind is reserve or release, which gives no row."""
    key = F.to_json(F.array("sensor_id", "event_id")).alias("key")
    held = requests.select(_bucket("sensor_id", "event_id"), key, "sensor_id", "event_id", "seq", "kind", "epoch", "at").withWatermark("at", f"{seconds} seconds")
    return held.groupBy("bucket").transformWithStateInPandas(ReplayKeys(seconds), "sensor_id string, event_id string, seq long, accepted boolean", "Append", "EventTime")

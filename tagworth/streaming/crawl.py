"""Crawl health on event streams.

Events have ``event_id, ts, proxy, proxy_type, domain, ok, error``.  State is kept per
domain or per proxy and domain, holds only what lies inside the hold period, and is
cleared by event-time timers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crawl import _in_slots, error_class, is_block

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOLD_SCHEMA = "domain string, event_id bigint, at bigint, hits bigint, hold_until bigint"
QUARANTINE_SCHEMA = "proxy string, domain string, event_id bigint, at bigint, streak bigint, hold_until bigint"


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts"))


def soft_block_stream(events: DataFrame, window_sec: int = 600, slide_sec: int = 60, threshold: int = 2, late: str = "10 minutes") -> DataFrame:
    """Alerts per domain and sliding window with at least ``threshold`` block events."""
    blocks = _micros(events).filter(is_block("error")).withWatermark("ts", late)
    counts = blocks.groupBy(F.window("ts", f"{window_sec} seconds", f"{slide_sec} seconds"), "domain").agg(
        F.count(F.lit(1)).alias("hits")
    )
    alerts = counts.filter(F.col("hits") >= threshold)
    return alerts.select("domain", F.col("window.start").alias("from"), F.col("window.end").alias("until"), "hits")


class _InOrder(StatefulProcessor):
    """Hands the events of a key to ``step`` in event order.

    Events wait in the state until the watermark has passed them, since an earlier one may
    come in a later batch; a timer of the earliest wakes the key.  So a key holds the
    events of the allowed lateness and what ``step`` keeps, and results do not depend on
    how events were dealt to files and batches.

    Waiting events are a map of time slots to lists: a batch touches the slots of its own
    events, and a timer those that have passed.  What ``step`` keeps is read and written
    once per call, so a burst of events costs in proportion to their number.
    """

    EVENT = "at: bigint, event_id: bigint, ok: boolean, kind: string"
    SLOT = 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot bigint", f"events array<struct<{self.EVENT}>>")
        self.kept = handle.getValueState("kept", self.KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, list] = {}
        for part in rows:
            for at, e, ok, kind in zip(part["at"], part["event_id"], part["ok"], part["kind"]):
                slots.setdefault(int(at) // self.SLOT, []).append((int(at), int(e), None if ok is None else bool(ok), kind))
        for slot, new in slots.items():
            held = self.pending.getValue((slot,)) if self.pending.containsKey((slot,)) else None
            self.pending.updateValue((slot,), ([*map(tuple, held[0] if held else ()), *new],))
        if slots:
            self.handle.registerTimer(min(e[0] for new in slots.values() for e in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        slots = sorted(slot for (slot,) in self.pending.keys())
        for slot in slots:
            if slot * self.SLOT >= passed:
                later.append(slot * self.SLOT)
                break
            events = [tuple(e) for e in self.pending.getValue((slot,))[0]]
            left = [e for e in events if e[0] >= passed]
            due += [e for e in events if e[0] < passed]
            if left:
                self.pending.updateValue((slot,), (left,))
                later.append(min(e[0] for e in left))
            else:
                self.pending.removeKey((slot,))
        kept = self.loaded(self.kept.get()) if self.kept.exists() else None
        out = []
        for at, event_id, ok, kind in sorted(due):
            kept, row = self.step(kept, at, ok, kind)
            out.append((*key, event_id, at, *row))
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        if kept is not None and self.over(kept, passed):
            kept = None
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(self.saved(kept))
            if due:
                self.handle.registerTimer(max(self.end(kept) // 1000 + 1, passed // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS).astype({"hold_until": "Int64"})

    def loaded(self, kept):
        return kept

    def saved(self, kept):
        return kept

    def close(self) -> None:
        pass


class _Holds(_InOrder):
    """Exact sliding count of a domain's block events and the hold it causes."""

    KEPT = "times array<bigint>, hold_until bigint"
    COLUMNS = ["domain", "event_id", "at", "hits", "hold_until"]

    def __init__(self, window: int, threshold: int, hold: int):
        self.window, self.threshold, self.hold = window, threshold, hold

    def loaded(self, kept):
        return deque(kept[0]), kept[1]

    def saved(self, kept):
        return list(kept[0]), kept[1]

    def step(self, kept, at, ok, kind):
        times, until = kept if kept is not None else (deque(), 0)
        while times and times[0] < at - self.window:
            times.popleft()
        times.append(at)
        if len(times) >= self.threshold:
            until = max(until, at + self.hold)
        return (times, until), (len(times), until if until > at else None)

    def end(self, kept) -> int:
        return max(kept[0][-1] + self.window, kept[1])

    def over(self, kept, passed: int) -> bool:
        return self.end(kept) < passed


def soft_block_holds(events: DataFrame, window_sec: int = 600, threshold: int = 2, hold_sec: int = 600, late: str = "10 minutes") -> DataFrame:
    """Every block event with its sliding count and the hold in force after it.

    An event is given out when the watermark has passed it.
    """
    kind = F.coalesce(error_class("error"), F.lit("none")).alias("kind")
    blocks = _micros(events).filter(is_block("error")).withWatermark("ts", late).select("domain", "event_id", "ts", "at", "ok", kind)
    return blocks.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=_Holds(window_sec * 1_000_000, threshold, hold_sec * 1_000_000),
        outputStructType=HOLD_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


class _Quarantine(_InOrder):
    """Failure streak and hold of one proxy on one domain."""

    KEPT = "streak bigint, hold_until bigint"
    COLUMNS = ["proxy", "domain", "event_id", "at", "streak", "hold_until"]

    def __init__(self, block_hold: int, network_hold: int, network_streak: int):
        self.block_hold, self.network_hold, self.network_streak = block_hold, network_hold, network_streak

    def step(self, kept, at, ok, kind):
        streak, until = kept if kept is not None else (0, 0)
        if ok:
            return None, (0, None)
        streak += 1
        if kind in ("soft_block", "hard_block"):
            until = max(until, at + self.block_hold)
        elif kind == "network" and streak >= self.network_streak:
            until = max(until, at + self.network_hold)
        return (streak, until), (streak, until if until > at else None)

    def end(self, kept) -> int:
        return kept[1]

    def over(self, kept, passed: int) -> bool:
        return False  # the streak lives on until a success


def quarantine_stream(
    events: DataFrame, block_sec: int = 600, network_sec: int = 300, network_streak: int = 2, late: str = "10 minutes"
) -> DataFrame:
    """Every finished fetch of rotating proxies with streak and hold of its proxy and domain.

    An event is given out when the watermark has passed it.
    """
    rows = (
        _micros(events)
        .filter((F.col("proxy_type") == "rotating") & F.col("ok").isNotNull())
        .withWatermark("ts", late)
        .select("proxy", "domain", "event_id", "ts", "at", "ok", F.coalesce(error_class("error"), F.lit("none")).alias("kind"))
    )
    return rows.groupBy("proxy", "domain").transformWithStateInPandas(
        statefulProcessor=_Quarantine(block_sec * 1_000_000, network_sec * 1_000_000, network_streak),
        outputStructType=QUARANTINE_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def quarantine_states(events: DataFrame, block_sec: int = 600, network_sec: int = 300, network_streak: int = 2) -> DataFrame:
    """Batch form of :func:`quarantine_stream`.

    Holds reach at most ``block_sec`` back, so they are found inside time slots with one
    slot of context; the streak crosses slots by its carry.
    """
    from ..operators.crawl import failure_streaks

    rotating = _micros(events).filter((F.col("proxy_type") == "rotating") & F.col("ok").isNotNull())
    # every failure counts here, so soft blocks are shown to the streak as plain failures
    kinds = rotating.withColumn("kind", error_class("error"))
    counted = failure_streaks(kinds.withColumn("error", F.when(F.col("kind").isNotNull(), F.lit("x"))), ("proxy", "domain"))
    candidate = (
        F.when(F.col("kind").isin("soft_block", "hard_block"), F.col("at") + block_sec * 1_000_000)
        .when((F.col("kind") == "network") & (F.col("streak") >= network_streak), F.col("at") + network_sec * 1_000_000)
    )
    marked = counted.withColumn("_c", candidate).withColumn("_at", F.col("at"))
    slots = _in_slots(marked, block_sec * 1_000_000)
    keys = ["proxy", "domain", "_slot"]
    run = Window.partitionBy(*keys).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    grouped = slots.withColumn("_g", F.sum(F.col("ok").cast("int")).over(run))
    inside = Window.partitionBy(*keys, "_g").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = grouped.withColumn("_until", F.max("_c").over(inside)).filter("_own")
    return held.select(
        "proxy", "domain", "event_id", "at", "streak", F.when(F.col("_until") > F.col("at"), F.col("_until")).alias("hold_until")
    )

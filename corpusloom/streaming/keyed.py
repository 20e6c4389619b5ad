"""State by key with event-time timers: rows in the order of their times, bursts of changes, bounded caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, late: str) -> DataFrame:
    """A stateful operator over a stream with the column ``at`` (timestamp), watermarked ``late`` behind the newest; adds ``at_ms`` for the processor.

    State and timers of this kind need the RocksDB store, which is set for the session where it isn't yet.
    """
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    marked = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis(F.col("at").cast("timestamp")))
    return marked.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


_LEAST = -(1 << 63)
_ID = f"nullif(id, {_LEAST + 1}) AS id"


def _timed(rows: DataFrame, payload) -> DataFrame:
    """A null id comes before all others."""
    return rows.where("at is not null").select("key", F.coalesce(F.col("id").cast("long"), F.lit(_LEAST + 1)).alias("id"), payload.cast("string").alias("payload"), "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))


class InOrder(StatefulProcessor):
    """Gives a key's rows to ``step`` in the order of (time, id), whatever their order of arrival.

    A row waits until the watermark has passed its time; later ones with an earlier time can't come then. ``step`` gets what is held for the key
    (None at first) and one row, and returns what to hold and output rows; ``idle`` gets it when the watermark has passed the time that
    ``due`` names for it. Times are microseconds.
    """

    HELD = ""  # the schema of what is held
    COLUMNS: list[str] = []  # of the output

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, payload string")
        self.held = handle.getValueState("held", self.HELD)

    def step(self, key, held, us: int, number: int, payload: str | None) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def unpacked(self, held: tuple):
        """What ``step`` works on, of what the state holds; once for all rows that are due."""
        return held

    def packed(self, held) -> tuple:
        return held

    def due(self, held) -> int | None:
        return None

    def idle(self, key, held) -> tuple[tuple | None, list[tuple]]:
        return held, []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for b in rows:
            got = [(int(u), int(i), p) for u, i, p in b[["us", "id", "payload"]].itertuples(index=False)]
            newest = max(newest, *(g[0] for g in got))
            self.waiting.appendList(got)
        self._wake(newest, timerValues)
        return iter(())  # a frame without rows costs as much as one with rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(w) for w in self.waiting.get())
        held = self.held.get()
        if held is None and not waiting:  # an earlier timer of this batch has taken all
            return
        held = None if held is None else self.unpacked(held)
        out: list[tuple] = []
        later = [w for w in waiting if w[0] > passed]
        for us, number, payload in waiting[: len(waiting) - len(later)]:
            held, new = self.step(key, held, us, number, payload)
            out += new
        due = None if held is None else self.due(held)
        if due is not None and due <= passed:
            held, new = self.idle(key, held)
            out += new
            due = None if held is None else self.due(held)
        if len(later) < len(waiting):
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if held is None:
            self.held.clear()
        else:
            self.held.update(self.packed(held))
        if due is not None:
            self._wake(due, timerValues)
        if out:
            yield self._frame(out)

    def _wake(self, us: int, timerValues) -> None:
        self.handle.registerTimer(max(-(-us // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    def close(self) -> None:
        pass


class _Burst(InOrder):
    HELD = "first long, last long, n long, id long, payload string"
    COLUMNS = ["key", "edge", "us", "id", "payload", "n"]

    def __init__(self, quiet_us: int, leading: bool, trailing: bool):
        self.quiet_us, self.leading, self.trailing = quiet_us, leading, trailing

    def step(self, key, held, us, number, payload):
        out = []
        if held is not None and us - held[1] >= self.quiet_us:
            held, out = self.idle(key, held)
        if held is not None:
            return (held[0], us, held[2] + 1, number, payload), out
        if self.leading:
            out = [*out, (key[0], "first", us, number, payload, 1)]
        return (us, us, 1, number, payload), out

    def due(self, held):
        return held[1] + self.quiet_us

    def idle(self, key, held):
        _, last, n, number, payload = held
        return None, [(key[0], "last", last, number, payload, n)] if self.trailing and (n > 1 or not self.leading) else []


def debounced(changes: DataFrame, quiet_ms: int, leading: bool = False, trailing: bool = True, late: str = "0 seconds") -> DataFrame:
    """Of each burst of changes to a key, the first one at once, or the last one after the quiet time, or both.

    changes: a stream of (key string, id long, payload string, at timestamp); the result is (key, edge ``first`` or ``last``, at, id, payload, n), where n is how many changes of the burst
    have been seen. Changes less than ``quiet_ms`` apart are one burst. A burst of one change has no ``last`` beside its ``first``. Changes count in the order of (at, id), however they arrive, as long
    as none is more than ``late`` behind the newest of all. What is held for a key is one open burst and what the watermark hasn't passed.
    Changes without a time are left out; a null key is a key, a null id comes before all others.
    """
    if not (leading or trailing):
        raise ValueError("neither edge is asked for")
    out = keyed(_timed(changes, F.col("payload")), ["key"], _Burst(quiet_ms * 1000, leading, trailing), "key string, edge string, us long, id long, payload string, n long", late)
    return out.select("key", "edge", F.timestamp_micros("us").alias("at"), F.expr(_ID), "payload", "n")


class _Cache(InOrder):
    HELD = "items array<string>, used array<long>"
    COLUMNS = ["key", "id", "item", "hit", "removed", "size"]

    def __init__(self, most: int, life_us: int):
        self.most, self.life_us = most, life_us

    def step(self, key, held, us, number, payload):
        cache = OrderedDict() if held is None else held
        while cache and us - next(iter(cache.values())) > self.life_us:
            cache.popitem(last=False)
        hit = payload in cache
        removed = None
        if hit:
            cache.move_to_end(payload)
        elif len(cache) >= self.most:
            removed = cache.popitem(last=False)[0]
        cache[payload] = us
        return cache, [(key[0], number, payload, hit, removed, len(cache))]

    def unpacked(self, held):
        return OrderedDict(zip(*held, strict=True))

    def packed(self, held):
        return list(held), list(held.values())

    def due(self, held):
        return held[next(reversed(held))] + self.life_us + 1 if held else None

    def idle(self, key, held):
        return None, []  # all entries have outlived their time


def cached(lookups: DataFrame, most: int = 100, life_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """Replays lookups through a cache of each key that holds the ``most`` items used last, none longer than ``life_ms`` after its last use.

    lookups: a stream of (key string, id long, payload string, at timestamp); the result has a row for each: (key, id, item, hit, the item removed for it, size after it). A missed item is stored.
    Lookups count in the order of (at, id), as in ``debounced``. The state of a key is at most ``most`` items, and goes when they have outlived their time.
    """
    out = keyed(_timed(lookups, F.coalesce("payload", F.lit(""))), ["key"], _Cache(most, life_ms * 1000), "key string, id long, item string, hit boolean, removed string, size int", late)
    return out.select("key", F.expr(_ID), "item", "hit", "removed", "size")

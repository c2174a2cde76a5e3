"""Streams with state per key: repeats within a time to live, throttling, floods, channels with caps and cooldowns.

State is a value or a map per key. Decisions go by the rows' own moments; a timer at the end of a
state's time lets it go once the watermark has passed, so what is held is bounded by the keys of that
time. A key's rows of one micro-batch are put in the order of time; the source bounds what a batch has.
Where keys are many, they are dealt to buckets whose state is a table of keys: a call into Python is one a
bucket, not one a key, and its keys are decided together.
State is kept by RocksDB, with its checkpoint in the stream's folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsgraph.operators.alerts import flood_step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(moments: pd.Series) -> np.ndarray:
    return moments.to_numpy().astype("datetime64[us]").astype(np.int64)


def _ordered(rows: Iterator[pd.DataFrame], *tie: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", *tie], kind="stable")


class _Timed(StatefulProcessor):
    """One timer a key, at the end of what its state is needed for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states(handle)

    def wake(self, timers, micros: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(micros // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


#: Buckets that keys are dealt to; fixed while a stream's state lives.
BUCKETS = 512


class _LastPassed(_Timed):
    """A row passes if its key's last one that passed is as long ago as the time to live. State: a bucket's keys, with when each last passed."""

    def __init__(self, keys: list[str], tie: str, seconds: float, drop: bool) -> None:
        self.keys, self.tie, self.time, self.drop = keys, tie, int(seconds * 1e6), drop

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "keys binary")

    def known(self) -> pd.DataFrame | None:
        import pyarrow as pa

        return pa.ipc.open_stream(self.last.get()[0]).read_pandas() if self.last.exists() else None

    def keep(self, known: pd.DataFrame) -> None:
        import pyarrow as pa

        table = pa.Table.from_pandas(known, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        self.last.update((out.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, self.tie).drop(columns="_bucket", errors="ignore")
        known, at = self.known(), _micros(rows["ts"])
        n = 0 if known is None else len(known)
        each = rows[self.keys] if known is None else pd.concat([known[self.keys], rows[self.keys]])
        number = each.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        last = np.full(number.max() + 1, np.iinfo(np.int64).min // 2)
        if n:
            last[number[:n]] = known["micros"].to_numpy()
        passed = passing(number[n:], at, last, self.time)
        now = timerValues.getCurrentWatermarkInMs() * 1000
        first = np.full(len(last), len(number))
        np.minimum.at(first, number, np.arange(len(number)))
        held = last + self.time > now  # others let pass whatever is not late
        self.keep(each.iloc[first[held]].assign(micros=last[held]))
        self.wake(timerValues, int(last.max()) + self.time)
        out = rows[passed] if self.drop else rows.assign(allowed=passed)
        yield out.reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


def passing(number: np.ndarray, at: np.ndarray, last: np.ndarray, time: int) -> np.ndarray:
    """Which rows (the numbers of their keys, moments in order) pass; last, when each key last passed, is brought up to date.

    All keys go from one row that passes to their next at once, as often as one of them has another.
    """
    passed = np.zeros(len(at), bool)
    moments, rank = np.unique(at, return_inverse=True)
    width = len(moments) + 1
    place = number.astype(np.int64) * width + rank  # by key and moment
    order = np.argsort(place, kind="stable")
    place = place[order]
    active, after = np.unique(number).astype(np.int64), 0
    while len(active):
        k = np.maximum(np.searchsorted(place, active * width + np.searchsorted(moments, last[active] + time)), after)
        more = k < np.searchsorted(place, (active + 1) * width)
        active, k = active[more], k[more]
        passed[order[k]] = True
        last[active] = at[order[k]]
        after = k + 1
    return passed


class _Flood(_Timed):
    """Attempts, start and whether it was told, of a key's current period."""

    def __init__(self, key: str, most: int, seconds: float, escalate: int) -> None:
        self.key, self.most, self.period, self.raise_at = key, most, seconds, escalate

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "attempts int, start double, escalated boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "id")
        now, passed, raised = self.now.get() if self.now.exists() else None, [], []
        for micros in _micros(rows["ts"]).tolist():
            now, ok, up = flood_step(now, micros / 1e6, self.most, self.period, self.raise_at)
            passed.append(ok)
            raised.append(up)
        self.now.update(now)
        self.wake(timerValues, int((now[1] + self.period) * 1e6))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), self.key: key[0], "allowed": passed, "escalates": raised})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        yield from ()


class _Channel(_Timed):
    """Per channel: how many were sent in each hour (a map), and when the last one was (a value)."""

    HOUR = 3_600_000_000

    def __init__(self, rules: dict[str, tuple[int, float]]) -> None:
        self.rules = rules

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.sent, self.last = handle.getMapState("sent", "hour long", "count int"), handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "id")
        most, cooldown = self.rules[key[0]]
        last = self.last.get()[0] if self.last.exists() else None
        counts, decisions = {}, []
        for at, open_ in zip(_micros(rows["ts"]).tolist(), rows["open"], strict=True):
            hour = at // self.HOUR
            if hour not in counts:
                counts[hour] = self.sent.getValue((hour,))[0] if self.sent.containsKey((hour,)) else 0
            if not open_:
                decisions.append("skipped")
            elif counts[hour] >= most:
                decisions.append("throttled")
            elif last is not None and at - last < cooldown * 60_000_000:
                decisions.append("skipped")
            else:
                decisions.append("sent")
                counts[hour] += 1
                last = at
        for hour, n in counts.items():
            self.sent.updateValue((hour,), (n,))
        if last is not None:
            self.last.update((last,))
        self.wake(timerValues, (max(counts) + 1) * self.HOUR)
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "channel": key[0], "decision": decisions})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() * 1000 // self.HOUR
        for (hour,) in [h for h in self.sent.keys() if h[0] < over]:  # noqa: SIM118
            self.sent.removeKey((hour,))
        if self.last.exists() and self.last.get()[0] + self.rules[key[0]][1] * 60_000_000 <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.last.clear()
        yield from ()


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)


def _last_passed(rows: DataFrame, keys: list[str], tie: str, seconds: float, drop: bool, schema: str, buckets: int) -> DataFrame:
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return _run(dealt, ["_bucket"], _LastPassed(keys, tie, seconds, drop), schema)


def first_seen(rows: DataFrame, *keys: str, seconds: float, tie: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (ts, keys, tie, ..) whose key didn't pass within the time to live before. The time isn't lengthened by repeats."""
    return _last_passed(rows, list(keys), tie, seconds, True, _schema(rows), buckets)


def throttle(rows: DataFrame, key: str, seconds: float = 60, tie: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """rows with allowed: at most one a key in the time after one that passed."""
    return _last_passed(rows, [key], tie, seconds, False, f"{_schema(rows)}, allowed boolean", buckets)


def flood_control(alerts: DataFrame, key: str, most: int = 3, minutes: float = 60, escalate: int = 5) -> DataFrame:
    """(id, key, allowed, escalates) of alerts (id, ts, key), as in batch."""
    return _run(alerts, [key], _Flood(key, most, minutes * 60, escalate), f"id long, {key} {dict(alerts.dtypes)[key]}, allowed boolean, escalates boolean")


def channel_decisions(alerts: DataFrame, channels: list[dict]) -> DataFrame:
    """(id, channel, decision) of alerts (id, ts) at channels (channel, enabled, days, from_hour, to_hour, per_hour, cooldown in minutes): a configured list."""
    each = F.explode(F.array(*[F.struct(F.lit(c["channel"]).alias("channel"), F.lit(c["enabled"]).alias("enabled"), F.array(*map(F.lit, c["days"])).alias("days"), F.lit(c["from_hour"]).alias("a"), F.lit(c["to_hour"]).alias("b")) for c in channels]))
    rows = alerts.select("id", "ts", each.alias("c"))
    hour = F.hour("ts")
    open_ = F.col("c.enabled") & F.array_contains("c.days", F.weekday("ts") + 1) & (hour >= F.col("c.a")) & (hour < F.col("c.b"))
    rules = {c["channel"]: (c["per_hour"], c["cooldown"]) for c in channels}
    return _run(rows.select("id", "ts", F.col("c.channel").alias("channel"), open_.alias("open")), ["channel"], _Channel(rules), "id long, channel string, decision string")

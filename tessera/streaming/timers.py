"""Stateful operators with timers of their own: rate limits, breakers with a probe lease, deadlines of pending work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; set it before a query starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "call_id"], kind="stable")


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


class RateLimit(StatefulProcessor):
    """Whether each call is let through: fewer than `limit` were in the window before it.

    State: a map from the millisecond to the calls let through then, `limit` entries a key at most, and the ids of a window's calls, so that a call that
    is delivered again gets the answer it got. A timer at the end of the key's last window clears both.
    """

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window = limit, int(window_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long", "n int")
        self.told = handle.getMapState("told", "call_id long", "at long, allowed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        told = {k[0]: v for k, v in self.told.iterator()}
        out = []
        for call, ts in zip(frame["call_id"].tolist(), frame["ts"], strict=True):
            now = _ms(ts)
            if call not in told:
                ok = sum(n for at, n in held.items() if now - self.window < at <= now) < self.limit
                if ok:
                    held[now] = held.get(now, 0) + 1
                told[call] = (now, ok)
            out.append(told[call][1])
        last = max(at for at, _ in told.values())
        # what lies a window before the watermark can't count for any call that may still come
        floor = timerValues.getCurrentWatermarkInMs() - self.window
        self.held.clear()
        for at, n in held.items():
            if at > floor:
                self.held.updateValue((at,), (n,))
        self.told.clear()
        for call, (at, ok) in told.items():
            if at > floor:
                self.told.updateValue((call,), (at, ok))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + self.window, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": key[0], "call_id": frame["call_id"].to_numpy(), "allowed": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.told.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "call_id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, limit: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """calls (key string, call_id long, ts timestamp): key, call_id, allowed. Calls that come more than `late` behind are dropped by the watermark."""
    return calls.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(RateLimit(limit, window_s), "key string, call_id long, allowed boolean", "append", "eventTime")


class Breaker(StatefulProcessor):
    """The phase of a provider after each call, and each change that a timer makes.

    Closed opens after `trips` failures in a row, for base x 2**(times - 1) seconds, cap at most. A timer then turns it half-open, whether or not a call comes. In half-open
    one call is the probe and holds a lease for lease_s; other calls are shed until its outcome is in. A probe that succeeds closes, one that fails opens
    for longer. A lease that runs out without an outcome (outcome null: the call has begun) is given up by a timer, and the next call may probe. A call's
    outcome comes as a row of the same call_id; calls delivered again change nothing.
    """

    def __init__(self, trips: int, base_s: float, cap_s: float, lease_s: float):
        self.trips, self.base, self.cap, self.lease = trips, int(base_s * 1000), int(cap_s * 1000), int(lease_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "phase string, failures int, until long, times int, probe long, lease long, last long, last_call long")

    def _load(self) -> list:
        return list(self.state.get()) if self.state.exists() else ["closed", 0, 0, 0, -1, 0, -1, -1]

    def _timers(self, s: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s[0] == "open":
            self.handle.registerTimer(s[2])
        elif s[0] == "half_open" and s[4] >= 0:
            self.handle.registerTimer(s[5])

    def _due(self, s: list, now: int) -> None:
        """What the time alone changes."""
        if s[0] == "open" and now >= s[2]:
            s[0], s[4] = "half_open", -1
        if s[0] == "half_open" and s[4] >= 0 and now >= s[5]:
            s[4] = -1

    def _failed(self, s: list, now: int) -> None:
        s[1] += 1
        if s[0] == "half_open" or s[1] >= self.trips:
            s[3] += 1
            s[0], s[1], s[2], s[4] = "open", 0, now + min(self.cap, self.base * 2 ** (s[3] - 1)), -1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, s, out = _ordered(rows), self._load(), []
        for call, ts, ok in zip(frame["call_id"].tolist(), frame["ts"], frame["ok"], strict=True):
            now = _ms(ts)
            if (now, call) <= (s[6], s[7]) and call != s[4]:
                out.append("seen")  # delivered again
                continue
            s[6], s[7] = max((now, call), (s[6], s[7]))
            self._due(s, now)
            begins = ok is None or pd.isna(ok)
            if s[0] == "open" or (s[0] == "half_open" and s[4] not in (-1, call)):
                out.append("shed")
                continue
            if begins:
                if s[0] == "half_open":
                    s[4], s[5] = call, now + self.lease
                out.append("probe" if s[0] == "half_open" else s[0])
                continue
            if ok:
                s[0], s[1], s[3], s[4] = "closed", 0, (0 if s[0] == "half_open" else s[3]), -1
            else:
                self._failed(s, now)
            out.append(s[0])
        self.state.update(tuple(s))
        self._timers(s)
        yield pd.DataFrame({"provider": key[0], "call_id": frame["call_id"].astype("Int64").to_numpy(), "phase": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        before = s[0]
        self._due(s, expiredTimerInfo.getExpiryTimeInMs())
        self.state.update(tuple(s))
        self._timers(s)
        changed = [s[0]] if s[0] != before else ["lease_lost"]
        yield pd.DataFrame({"provider": [key[0]], "call_id": pd.array([-1], dtype="int64"), "phase": changed})

    def close(self) -> None:
        pass


def breakers(calls: DataFrame, trips: int = 3, base_s: float = 30.0, cap_s: float = 600.0, lease_s: float = 10.0, late: str = "0 seconds") -> DataFrame:
    """calls (provider string, call_id long, ts timestamp, ok boolean, null: begun): provider, call_id (-1: a timer), phase: closed, open, half_open, shed, probe,
    seen, lease_lost."""
    return calls.withWatermark("ts", late).groupBy("provider").transformWithStateInPandas(Breaker(trips, base_s, cap_s, lease_s), "provider string, call_id long, phase string", "append", "eventTime")

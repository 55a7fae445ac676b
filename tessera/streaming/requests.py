"""A queue of run requests as a stateful stream: claims, completions, limits, and requests that time out.

Of each queue the state holds the open request alone and when the last one was accepted, so it does not grow with the log.
A request waits at most ``WAIT`` and runs at most ``RUN``; event-time timers end those of which nothing more is heard.  One
that has waited for ``CLAIM`` is not claimed any more, and within ``AGAIN`` after a request no other is accepted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAIT, RUN, CLAIM, AGAIN = dt.timedelta(minutes=20), dt.timedelta(hours=3), dt.timedelta(minutes=15), dt.timedelta(minutes=10)
OUT = "queue int, request_id long, requested_at timestamp, outcome string, at timestamp"
STATE = "status string, request_id long, requested long, since long, accepted long"
_US = dt.timedelta(microseconds=1)
Open = tuple[str, int, int, int]  # status, request, when it was asked for, when its status began; times in microseconds


def step(state: Open | None, accepted: int | None, kind: str, request: int, now: int) -> tuple[Open | None, int | None, list[tuple[int, int, str, int]]]:
    """The state after an event, when a request was last accepted, and the requests that ended: (id, asked, outcome, at)."""
    ended = []
    if state and (late := overdue(state)) < now:
        ended.append((state[1], state[2], f"expired_{state[0]}", late))
        state = None
    if kind == "request":
        if accepted is not None and now - accepted < AGAIN // _US:
            ended.append((request, now, "rate_limited", now))
        elif state:
            ended.append((request, now, "already_running", now))
        else:
            state, accepted = ("pending", request, now, now), now
    elif kind == "claim" and state and state[0] == "pending" and now - state[2] < CLAIM // _US:
        state = ("running", state[1], state[2], now)
    elif kind == "complete" and state and state[0] == "running":
        ended.append((state[1], state[2], "completed", now))
        state = None
    return state, accepted, ended


def overdue(state: Open) -> int:
    """When an open request times out."""
    return state[3] + (WAIT if state[0] == "pending" else RUN) // _US


class RequestQueue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("open", STATE)

    def _read(self) -> tuple[Open | None, int | None]:
        if not self.state.exists():
            return None, None
        status, request, asked, since, accepted = self.state.get()
        return (status, request, asked, since) if status else None, accepted

    def _write(self, state: Open | None, accepted: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state:
            self.handle.registerTimer(-(-overdue(state) // 1000))
        if state is None and accepted is None:
            self.state.clear()
        else:
            self.state.update((*(state or (None, None, None, None)), accepted))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, accepted = self._read()
        every, out = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable"), []
        for at, kind, request in zip(every["ts"].astype("datetime64[us]").astype("int64").tolist(), every["kind"], every["request_id"].tolist()):
            state, accepted, ended = step(state, accepted, kind, request, at)
            out += ended
        self._write(state, accepted)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, accepted = self._read()
        out = []
        if state and overdue(state) <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            out.append((state[1], state[2], f"expired_{state[0]}", overdue(state)))
            self.state.clear()  # the last acceptance is older than any limit by now
        yield self._frame(key, out)

    @staticmethod
    def _frame(key: Any, out: list) -> pd.DataFrame:
        ids, asked, outcome, at = zip(*out) if out else ((), (), (), ())
        times = lambda x: pd.to_datetime(pd.Series(list(x), dtype="int64"), unit="us", utc=True)
        return pd.DataFrame({"queue": pd.Series([key[0]] * len(out), dtype="int32"), "request_id": pd.Series(list(ids), dtype="int64"), "requested_at": times(asked), "outcome": pd.Series(list(outcome), dtype="object"), "at": times(at)})

    def close(self) -> None:
        pass


def request_states(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """What became of each request of a stream (queue, request_id, kind, ts), kind being request, claim or complete."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("ts", late).groupBy("queue").transformWithStateInPandas(RequestQueue(), OUT, "append", "eventTime")

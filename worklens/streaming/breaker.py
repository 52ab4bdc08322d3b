"""Circuit breaker of sources as keyed state: runs are put in order of their own time, and a timer ends the cooldown.

Runs may come in any order within a watermark's delay. Those beyond the watermark
wait in a buffer of their source; once the watermark has passed them they are applied in order of time, and a
timer wakes a source for its next waiting run or for the end of its cooldown, though no run of it may follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

#: ``change`` is opened, closed, or state: the source's state after all runs known so far, numbered by ``seq``.
CHANGES = "source string, seq long, change string, at double, ok_streak long, fail_streak long, last_ok double, cooldown_until double"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, while a stream starts."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Circuit(NamedTuple):
    """State of one source after its runs up to some moment; ``is_open`` until a success or the cooldown's end."""

    ok_streak: int = 0
    fail_streak: int = 0
    last_ok: float = 0.0
    cooldown_until: float = 0.0
    is_open: bool = False

    def until(self, ts: float) -> tuple[Circuit, list[tuple]]:
        """At ``ts``, without a run: the cooldown may have ended before."""
        if self.is_open and self.cooldown_until <= ts:
            after = self._replace(is_open=False)
            return after, [("closed", self.cooldown_until, *after[:4])]
        return self, []

    def after(self, ts: float, ok: bool) -> tuple[Circuit, list[tuple]]:
        """After a run at ``ts``, with the changes up to it."""
        state, changes = self.until(ts)
        if ok:
            after = Circuit(state.ok_streak + 1, 0, ts, 0.0, False)
        else:
            trips = state.fail_streak + 1 >= fixed.BREAKER_FAILURES
            after = Circuit(0, state.fail_streak + 1, state.last_ok, ts + fixed.BREAKER_COOLDOWN if trips else state.cooldown_until, state.is_open or trips)
        if after.is_open != state.is_open:
            changes.append(("opened" if after.is_open else "closed", ts, *after[:4]))
        return after, changes


class Breaker(StatefulProcessor):
    """Per source: the circuit after the runs that the watermark has passed, and the runs that still wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "ok_streak long, fail_streak long, last_ok double, cooldown_until double, is_open boolean, seq long")
        self.waiting = handle.getValueState("waiting", "ts array<double>, run_id array<long>, ok array<boolean>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(frame["ts"].tolist(), frame["run_id"].tolist(), frame["ok"].tolist(), strict=True)]
        return self._advance(key[0], new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return self._advance(key[0], [], timerValues.getCurrentWatermarkInMs() / 1000)

    def _advance(self, source: str, new: list[tuple], mark: float) -> Iterator[pd.DataFrame]:
        held = self.settled.get()
        circuit, seq = (Circuit(*held[:5]), held[5]) if held else (Circuit(), 0)
        waiting = sorted([*zip(*self.waiting.get(), strict=True), *new] if self.waiting.exists() else new)
        changes: list[tuple] = []
        done = 0
        for ts, _, ok in waiting:
            if ts > mark:
                break
            circuit, some = circuit.after(ts, ok)
            changes += some
            done += 1
        waiting = waiting[done:]
        circuit, some = circuit.until(mark)
        changes += some
        known = circuit
        for ts, _, ok in waiting:
            known, _ = known.after(ts, ok)
        changes.append(("state", waiting[-1][0] if waiting else mark, *known[:4]))
        self.settled.update((*circuit, seq + len(changes)))
        self.waiting.update(tuple(list(c) for c in zip(*waiting, strict=True)) if waiting else ([], [], []))
        # Timers are in milliseconds; one that the watermark has passed fires in the same batch.
        wake = [waiting[0][0]] if waiting else []
        wake += [circuit.cooldown_until] if circuit.is_open else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake:
            self.handle.registerTimer(int(min(wake) * 1000) + 1)
        yield pd.DataFrame([(source, seq + k + 1, *c) for k, c in enumerate(changes)], columns=[c.split()[0] for c in CHANGES.split(", ")])


def breaker_changes(source_runs: DataFrame, delay: str) -> DataFrame:
    """Stream of CHANGES for a stream of runs (source, ts in seconds, run_id, ok); no run may come later than ``delay`` behind the latest.

    ``opened`` and ``closed`` come once the watermark has passed them, in order of time; ``state`` also counts the runs that
    still wait, so the row of a source with the highest ``seq`` is its state after everything that came.
    """
    timed = source_runs.select("source", "ts", "run_id", "ok", F.timestamp_seconds("ts").alias("at")).withWatermark("at", delay)
    return timed.groupBy("source").transformWithStateInPandas(Breaker(), CHANGES, "append", "eventTime")


def latest_state(changes: DataFrame) -> DataFrame:
    """Per source the last of its state rows, without what the stream numbers them by."""
    fields = ["ok_streak", "fail_streak", "last_ok", "cooldown_until"]
    last = changes.where("change = 'state'").groupBy("source").agg(F.max_by(F.struct(*fields), "seq").alias("s"))
    return last.select("source", "s.*")

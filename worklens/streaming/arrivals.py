"""Partial results of runs as a stream: what arrives inside a run's wall budget is used, and a timer closes the run."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: ``kind`` is used or late (a batch), or closed (the run: how many batches it used of how many sources).
ARRIVALS = "run_id long, kind string, batch_id long, source string, at double, n_used long, n_sources long"


class Arrivals(StatefulProcessor):
    """Per run: its start, and batches used by source until it closes; then its state is gone."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started_at double, sources array<string>, counts array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.run.get()
        started, counts = (held[0], dict(zip(held[1], held[2], strict=True))) if held else (None, {})
        for frame in rows:
            inside = frame["arrived_at"] <= frame["started_at"] + self.budget
            for source, n in frame.loc[inside, "source"].value_counts().items():
                counts[source] = counts.get(source, 0) + int(n)
            if inside.any():
                started = float(frame.loc[inside, "started_at"].iloc[0])
            yield pd.DataFrame({
                "run_id": key[0], "kind": inside.map({True: "used", False: "late"}), "batch_id": frame["batch_id"], "source": frame["source"], "at": frame["arrived_at"],
                "n_used": pd.Series([None] * len(frame), dtype="Int64"), "n_sources": pd.Series([None] * len(frame), dtype="Int64"),
            })
        if started is not None:
            # Timers are in milliseconds; at the budget's last moment a batch still counts.
            self.handle.registerTimer(int((started + self.budget) * 1000) + 1)
            self.run.update((started, list(counts), list(counts.values())))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        started, sources, counts = self.run.get()
        self.run.clear()
        yield pd.DataFrame([(key[0], "closed", None, None, started + self.budget, sum(counts), len(sources))], columns=[c.split()[0] for c in ARRIVALS.split(", ")])


def arrivals(batches: DataFrame, delay: str, budget: int = 120) -> DataFrame:
    """Stream of ARRIVALS for a stream of batches (run_id, batch_id, source, started_at, arrived_at in seconds), which may come up to ``delay`` out of order.

    A batch is used or late by its own time, so the result does not depend on how the stream is cut; a run with a batch in time is closed once the
    watermark passes its start and the budget.
    """
    timed = batches.withColumn("at", F.timestamp_seconds("arrived_at")).withWatermark("at", delay)
    return timed.groupBy("run_id").transformWithStateInPandas(Arrivals(budget), ARRIVALS, "append", "eventTime")

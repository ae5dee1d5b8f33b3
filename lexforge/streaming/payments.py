"""Payments decided from their operator's events as they come, late, doubled and in any order.

A payment is decided by the first of its final events in their own time. Only once the watermark has passed that event can
none before it come any more, so a timer decides there, and the decisions are those that `ledger.payment_states` takes over
the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "reference string, status string, at timestamp"
# The states that a payment does not leave.
FINAL = ("SUCCESSFUL", "FAILED")
#: How long, in the events' own time, a payment may stay without a final event, and how long a decided one is remembered.
WAITING_MS, REMEMBERED_MS = 24 * 3600 * 1000, 24 * 3600 * 1000


class Payments(StatefulProcessor):
    """A state machine for each reference: waiting, final, decided. at: in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("payment", "decided boolean, final boolean, status string, at long")

    def _turn(self, decided: bool, final: bool, status: str, at: int) -> None:
        """Take a state, and wake up when it ends."""
        self.state.update((decided, final, status, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + (REMEMBERED_MS if decided else 1 if final else WAITING_MS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        seen = [] if held is None else [(held[3], held[2])]
        for frame in rows:
            seen += [(int(at.timestamp() * 1000), status) for at, status in zip(frame["at"], frame["status"])]
        if held is None or not held[0]:
            finals = [x for x in seen if x[1] in FINAL]
            at, status = min(finals) if finals else max(seen)
            self._turn(False, bool(finals), status, at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        decided, final, status, at = self.state.get()
        if decided:
            self.state.clear()
            return
        self._turn(True, final, status, at)
        yield pd.DataFrame({"reference": [key[0]], "status": [status], "at": [pd.Timestamp(at, unit="ms")]})


def payment_decisions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """reference, status and at (of the deciding event) of a stream of events(reference, status, at), once for each reference:
    its first final event, or its last one if for a day there is none. delay: how late events may be; later ones are dropped.
    Needs a state store with timers, such as RocksDB's."""
    columns = events.select("reference", "status", "at").where("reference IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL")
    return columns.withWatermark("at", delay).groupBy("reference").transformWithStateInPandas(Payments(), DECISIONS, outputMode="Append", timeMode="EventTime")

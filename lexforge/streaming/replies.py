"""Replies of a model as events, while their fragments are still arriving.

The state of a reply is where its reader stands and the few characters whose meaning is still open, never what has been
read; fragments that come before their turn wait for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.json_stream import Reader

EVENTS = "reply_id long, seq long, kind string, text string"
#: After so long without a fragment, in the fragments' own time, a reply that has not ended has failed, and one that has is
#: forgotten; until then, repeats of its fragments say nothing.
SILENCE_MS = 10 * 60 * 1000


class Replies(StatefulProcessor):
    """Of every reply "text" events, each with what a fragment lets be shown, and one "end", or "error" where it has failed or
    has shown nothing or falls silent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reader = handle.getValueState("reader", "place string, open string, next long, shown boolean, last long")
        self.early = handle.getMapState("early", "seq long", "fragment string, status string")
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        place, opened, turn, shown, last = self.reader.get() if self.reader.exists() else ("before", "", 0, False, 0)
        reader, events, waiting = Reader(place, opened), [], {}
        for frame in rows:
            last = max(last, int(frame["at"].max().timestamp() * 1000))
            waiting |= {int(s): (f, x) for s, f, x in zip(frame["seq"], frame["fragment"], frame["status"]) if s >= turn}
        while place != "closed":
            if turn in waiting:
                fragment, status = waiting.pop(turn)
            elif self.early.containsKey((turn,)):
                fragment, status = self.early.getValue((turn,))
                self.early.removeKey((turn,))
            else:
                break
            if text := reader.read(fragment or ""):
                events.append((key[0], turn, "text", text))
                shown = True
            if status in ("done", "failed"):
                events.append((key[0], turn, "end" if status == "done" and shown else "error", None))
                place = "closed"
            turn += 1
        if place == "closed":
            self.early.clear()
            reader = Reader("after")
        else:
            for seq, held in waiting.items():
                self.early.updateValue((seq,), held)
        self.reader.update(("closed" if place == "closed" else reader.place, reader.open, turn, shown, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + SILENCE_MS)
        if events:
            yield pd.DataFrame(events, columns=["reply_id", "seq", "kind", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        place, _, turn, *_ = self.reader.get()
        self.reader.clear()
        self.early.clear()
        if place != "closed":
            yield pd.DataFrame([(key[0], turn, "error", None)], columns=["reply_id", "seq", "kind", "text"])


def reply_events(fragments: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """reply_id, seq, kind and text of a stream of fragments(reply_id, seq, fragment, status, at), seq from 0 without gaps, in any
    order and possibly repeated; status: "done" or "failed" with a reply's last fragment, else null; at: when a fragment was sent. delay: how late fragments may be. Needs a state
    store with several states a key, such as RocksDB's."""
    columns = fragments.selectExpr("CAST(reply_id AS LONG) AS reply_id", "CAST(seq AS LONG) AS seq", "fragment", "status", "at")
    return columns.withWatermark("at", delay).groupBy("reply_id").transformWithStateInPandas(Replies(), EVENTS, outputMode="Append", timeMode="EventTime")


def _read_in_order(fragments: DataFrame, whole: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply, reader, so_far = None, Reader(), ""
        for frame in frames:
            found = []
            for key, seq, fragment in zip(frame["reply_id"], frame["seq"], frame["fragment"]):
                if key != reply:
                    reply, reader, so_far = key, Reader(), ""
                if text := reader.read(fragment or ""):
                    so_far = so_far + text if whole else text
                    found.append((key, seq, so_far))
            yield pd.DataFrame(found, columns=["reply_id", "seq", name])

    name, kinds = "shown" if whole else "text", dict(fragments.dtypes)
    ordered = fragments.select("reply_id", "seq", "fragment").repartition("reply_id").sortWithinPartitions("reply_id", "seq")
    return ordered.mapInPandas(run, f"reply_id {kinds['reply_id']}, seq {kinds['seq']}, {name} string")


def shown_texts(fragments: DataFrame) -> DataFrame:
    """reply_id, seq and text of a table of fragments(reply_id, seq, fragment): what each fragment lets be shown, in one pass."""
    return _read_in_order(fragments, whole=False)


def shown_answers(fragments: DataFrame) -> DataFrame:
    """reply_id, seq and shown of fragments(reply_id, seq, fragment): what of the answer has safely arrived by each fragment
    that lengthens it. Every fragment is read once; only what is returned grows with the reply."""
    return _read_in_order(fragments, whole=True)

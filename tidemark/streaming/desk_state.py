"""The desk's states: bench, at work, record; the same machine over a stream and over a table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = ["bench", "working", "record"]
#: What each event does in the states that take it; a commission while one is at work is ignored, as all others are.
MOVES = {"commission": {"bench": "working"}, "settle": {"working": "record"}, "reopen": {"record": "bench"}}
#: The given events as the desk's.
EVENTS = {"click": "commission", "view": "settle", "purchase": "reopen"}


def as_desk_events(events: DataFrame) -> DataFrame:
    """The events with a column ``event``, null where an event isn't the desk's."""
    named = F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair))
    return events.withColumn("event", F.try_element_at(named, F.col("event_type")))


class Desk(StatefulProcessor):
    """A user's state, kept from batch to batch; a batch's events are taken by time and then id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else STATES[0]
        given = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        states, moved = [], []
        for event in given["event"]:
            to = MOVES.get(event, {}).get(now, now)
            states.append(to)
            moved.append(to != now)
            now = to
        self.state.update((now,))
        yield pd.DataFrame({"event_id": given["event_id"], "user_id": key[0], "state": states, "moved": moved})

    def close(self) -> None:
        pass


def desk_stream(events: DataFrame) -> DataFrame:
    """(event_id, user_id, state, moved) for a stream of desk events (user_id, event_id, ts, event).

    State is a word a user.  Events of a user in later batches count as later ones.
    """
    return events.groupBy("user_id").transformWithStateInPandas(Desk(), "event_id bigint, user_id bigint, state string, moved boolean", "append", "none")

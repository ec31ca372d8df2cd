"""A sender that may not be there yet: a bounded queue with doubling retries, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pacegrid.streaming.fixes import LATE

C = F.col
# --- fixed values -----------------------------------------------------------
#: Calls that wait at most, retries, and the first delay in milliseconds; each next one is twice as long.
QUEUE_MAX, RETRIES, FIRST_MS = 32, 5, 1000


class Line:
    """What waits of one session, and when it is tried again; ``due`` is None where no retry is set."""

    def __init__(self, waiting: list[int], retries: int, due: int | None):
        self.waiting, self.retries, self.due = waiting, retries, due

    def until(self, now: int, ready: int) -> Iterator[tuple[int, int]]:
        """Retries that are due by ``now``: (event, moment) of what they send; the last one that fails gives up what waits."""
        while self.due is not None and self.due <= now:
            moment, self.due = self.due, None
            self.retries += 1
            if moment >= ready:
                yield from ((event, moment) for event in self.waiting)
            if moment >= ready or self.retries >= RETRIES:
                self.waiting = []
            else:
                self.due = moment + FIRST_MS * 2**self.retries

    def call(self, event: int, now: int, ready: int) -> Iterator[tuple[int, int]]:
        """A call at ``now``: all that waits goes before it if the sender is there, else it waits, too, if there is room."""
        if now >= ready:
            yield from ((e, now) for e in [*self.waiting, event])
            self.waiting = []
        else:
            self.waiting += [event] * (len(self.waiting) < QUEUE_MAX)
            if self.due is None and self.retries < RETRIES:
                self.due = now + FIRST_MS * 2**self.retries


def delivered(calls: DataFrame) -> DataFrame:
    """(session, event_id, at): the calls that reach the sender and when, of (session, event_id, t, ready, ts) in milliseconds of event time.

    A session's sender is there from ``ready`` on.  Retries that come due between two calls
    are made up for before the later one, and those of a silent session when the watermark
    has passed them.  ``ts`` is ``t`` as event time.  Calls of a session within a batch are taken in order of t and event_id.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, retries, due, ready = state.get if state.exists else ("", 0, None, None)
        line = Line([int(x) for x in waiting.split(",") if x], retries, due)
        out: list[tuple[int, int]] = []
        if state.hasTimedOut:
            out += line.until(state.getCurrentWatermarkMs(), ready)
        else:
            for r in pd.concat(list(pdfs)).sort_values(["t", "event_id"]).itertuples():
                ready = int(r.ready)
                out += line.until(int(r.t), ready)
                out += line.call(int(r.event_id), int(r.t), ready)
        state.update((",".join(map(str, line.waiting)), line.retries, line.due, ready))
        if line.due is not None:
            state.setTimeoutTimestamp(max(line.due, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame([(key[0], event, at) for event, at in out], columns=["session", "event_id", "at"])

    kept = calls.withWatermark("ts", LATE)
    return kept.groupBy("session").applyInPandasWithState(step, "session long, event_id long, at long", "waiting string, retries int, due long, ready long", "append", GroupStateTimeout.EventTimeTimeout)

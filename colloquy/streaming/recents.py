"""Recent searches of each user as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from colloquy.streaming.state import keyed

RECENT = 5
OUTPUT = "user_id long, queries array<string>, modes array<string>"


class Recent(StatefulProcessor):
    """The newest RECENT distinct (query, mode) of a user, newest first; rows may come late or out of order.

    ``ttl_ms``: a search that is not repeated for so long is forgotten by the store (None: never).
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "query string, mode string", "at long", self.ttl_ms)

    def handleInputRows(self, key: tuple[int], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {(q, m): at for (q, m), (at,) in self.kept.iterator()}
        kept = dict(before)
        for pdf in rows:
            for query, mode, at in zip(pdf["query"].str.strip(), pdf["mode"], pdf["at"]):
                if query:
                    kept[query, mode] = max(int(at), kept.get((query, mode), -1))
        top = sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:RECENT]
        for search in before.keys() - dict(top).keys():
            self.kept.removeKey(search)
        for search, at in top:
            if before.get(search) != at:  # what stays as it was keeps its age
                self.kept.updateValue(search, (at,))
        yield pd.DataFrame({"user_id": [key[0]], "queries": [[q for (q, _), _ in top]], "modes": [[m for (_, m), _ in top]]})

    def close(self) -> None:
        pass


def recent_searches(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (user_id, query, mode, at in ms) as each user's list, in update mode. State is RECENT rows a user."""
    return keyed(events, "user_id", Recent(ttl_ms), OUTPUT, "ProcessingTime" if ttl_ms else "None")

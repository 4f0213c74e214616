"""Sections of conversations while their turns come in: ``segment.turn_sections`` as a state machine of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from colloquy.streaming.state import keyed

OUTPUT = "conv_id long, ord long, turns long, question string, answer string, type string"
#: The open section of a conversation: its row, the last turn's number and role.
OPEN = "ord long, turns long, question string, answer string, last long, role string"


def joined(text: str, more: str | None) -> str:
    return text if more is None else f"{text} {more}" if text else more


class Sections(StatefulProcessor):
    """State is the open section alone, so it does not grow with a conversation's number of turns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple[int], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = sorted((r for pdf in rows for r in zip(pdf["turn"].tolist(), pdf["role"].tolist(), pdf["text"].tolist())), key=lambda r: r[0])
        at, count, question, answer, last, role = self.open.get() if self.open.exists() else (0, 0, "", "", None, "")
        out = []
        for turn, speaker, text in turns:
            if last is not None and turn <= last:
                out.append((key[0], None, 1, text if speaker == "user" else "", text if speaker == "assistant" else "", "late"))
                continue
            if speaker == "user" and role != "user":
                if count:
                    out.append((key[0], at, count, question, answer, "question" if at else "intro"))
                at, count, question, answer = at + 1, 0, "", ""
            count, last, role = count + 1, turn, speaker
            if speaker == "user":
                question = joined(question, text)
            elif speaker == "assistant":
                answer = joined(answer, text)
        if last is not None:
            self.open.update((at, count, question, answer, last, role))
            out.append((key[0], at, count, question, answer, "question" if at else "intro"))
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        made = pd.DataFrame(out, columns=names)
        yield made.astype({"ord": "Int64", "turns": "int64"})

    def close(self) -> None:
        pass


def turn_sections(turns: DataFrame) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) as sections, in update mode: of rows with one (conv_id, ord) the last counts.

    Turns of one batch may come in any order, later batches have later turns of a conversation. A turn that comes behind a later
    one of an earlier batch cannot change what was put out: it comes out as a row of type ``late`` without ``ord``.
    """
    return keyed(turns.where("role <> 'system'").select("conv_id", "turn", "role", "text"), "conv_id", Sections(), OUTPUT)

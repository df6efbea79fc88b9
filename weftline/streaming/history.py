"""The last messages of each conversation as a stream arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "conv_id bigint, turns array<int>, contents array<string>"
_STATE = "turns array<int>, contents array<string>"


def last_messages_stream(messages: DataFrame, n: int = 10, idle: str | None = None) -> DataFrame:
    """(conv_id, turns, contents): after each batch, the last ``n`` messages of every conversation it touched.

    ``messages``: a stream of conv_id, turn, content. The state of a conversation holds
    ``n`` messages at most; with ``idle`` (a duration) it is given up after that time without a message. A turn that comes again
    replaces the earlier one. Rows with a null conversation or turn are ignored.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get)) if state.exists else {}
        for batch in batches:
            known.update(zip(batch["turn"].astype(int), batch["content"]))
        turns = sorted(known)[-n:]
        contents = [known[t] for t in turns]
        state.update((turns, contents))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "contents": [contents]})

    some = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "content")
    return some.groupBy("conv_id").applyInPandasWithState(update, _OUT, _STATE, "update", timeout)

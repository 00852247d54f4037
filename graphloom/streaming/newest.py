"""The newest change of each path, kept in a stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Changes of one path that wait together at most, and how long they wait for another (milliseconds).
WAITING, DELAY_MS = 32, 1500

CHANGE = "path string, change string, at long"
#: The newest time passed on, the change that waits (its time is -1 if none does), how many it stands for.
_STATE = "passed long, change string, at long, waiting int"


def _step(delay: int, most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed, change, at, waiting = state.get if state.exists else (-1, "", -1, 0)
        for rows in batches:
            newer = rows[rows["at"] > max(passed, at)]
            waiting += int((rows["at"] > passed).sum())
            if len(newer):
                # of changes at one time the last by name stands, whatever their order
                last = newer.sort_values(["at", "change"]).iloc[-1]
                change, at = str(last["change"]), int(last["at"])
        ready = at > passed and (state.hasTimedOut or not delay or waiting >= most)
        if ready:
            yield pd.DataFrame({"path": [key[0]], "change": [change], "at": [at]})
            passed, change, at, waiting = at, "", -1, 0
        state.update((passed, change, at, waiting))
        if at > passed:
            state.setTimeoutDuration(delay)

    return run


def newest_changes(changes: DataFrame, delay_ms: int = DELAY_MS, waiting: int = WAITING) -> DataFrame:
    """A stream of changes (path, change, at) with the newest of each path, once none has followed for ``delay_ms``
    or ``waiting`` have come; changes that are not newer than one passed on are dropped, in whatever batch they come.

    Without a delay the newest of each batch goes on at once. The state has a row for each path that ever changed.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if delay_ms else GroupStateTimeout.NoTimeout
    return changes.groupBy("path").applyInPandasWithState(_step(delay_ms, waiting), CHANGE, _STATE, "append", timeout)

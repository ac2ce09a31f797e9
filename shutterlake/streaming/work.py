"""Indexing as a stream: items are encoded as they come, failures are tried again by timers, and what keeps failing becomes a dead letter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mutations import encoded

#: One row per attempt: status is ready, failed (to be tried again at retry_at) or dead.
ATTEMPT = "asset_id long, status string, failures int, at timestamp, retry_at timestamp, vector array<double>"


def wait(failures: int) -> timedelta:
    """30 seconds times 2 to the failures so far, an hour at most."""
    return timedelta(seconds=min(3600.0, 30.0 * 2.0 ** min(failures, 60)))


def index_stream(items: DataFrame, encode: Callable[[str], list[float]], most: int = 8, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """A stream of attempts (ATTEMPT) over a stream of items (asset_id, text, at).

    An item that comes is encoded; one that fails waits in the state with its count of failures, under a timer, and is encoded
    again when that runs out. After `most` failures it goes out as dead, and its state with it. A newer item of an asset takes the
    older one's place and starts anew. Timers follow the watermark of `at` (late behind the greatest), so a feed that is replayed
    gives the same attempts; by_clock has them follow the clock instead, for a feed that may fall silent. State holds what waits,
    nothing else. How much a batch takes is up to the source (such as maxFilesPerTrigger)."""

    def attempt(key: int, text: str | None, failures: int, at: datetime, state: GroupState) -> pd.DataFrame:
        vector = encoded([text], encode)[0]
        if vector is not None:
            status, failures, due = "ready", 0, None
        else:
            due, failures = at + wait(failures), failures + 1
            status, due = ("dead", None) if failures >= most else ("failed", due)
        if due is None:
            if state.exists:
                state.remove()
        else:
            state.update((text, failures, at, due))
            if by_clock:
                state.setTimeoutDuration(max(1, int((due - at).total_seconds() * 1000)))
            else:  # a timer may not lie before the watermark: then the next batch tries again
                state.setTimeoutTimestamp(max(int(due.replace(tzinfo=timezone.utc).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        return pd.DataFrame({"asset_id": [key], "status": [status], "failures": pd.array([failures], "Int32"), "at": [at], "retry_at": [due], "vector": [vector]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            text, failures, _, due = state.get
            yield attempt(key[0], text, failures, due, state)
            return
        rows = pd.concat(list(batches))  # the items of one asset in one batch
        last = rows.sort_values(["at", "text"], na_position="first").iloc[-1]
        if not state.exists or state.get[2] <= last["at"].to_pydatetime():
            yield attempt(key[0], None if pd.isna(last["text"]) else last["text"], 0, last["at"].to_pydatetime(), state)

    timed = items.select("asset_id", "text", F.col("at").cast("timestamp").alias("at")).where("asset_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    kind = GroupStateTimeout.ProcessingTimeTimeout if by_clock else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("asset_id").applyInPandasWithState(step, ATTEMPT, "text string, failures int, at timestamp, retry_at timestamp", "append", kind)


def last_attempts(attempts: DataFrame) -> DataFrame:
    """(asset_id, status, failures, retry_at, vector) after the last attempt of every asset; `dead` rows are the dead letters."""
    last = F.max_by(F.struct("status", "failures", "retry_at", "vector"), F.struct("at", "failures"))
    return attempts.groupBy("asset_id").agg(last.alias("v")).select("asset_id", "v.*")

"""The retry state of links as a stream: state for each link, timers for its next attempt."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import BACKOFF_BASE, BACKOFF_CEILING, BACKOFF_DOUBLINGS
from ..operators.retry import GATE_SECONDS, MAX_ATTEMPTS
from .messages import WATERMARK

#: What keeps the state; link state needs a store with column families.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "status string, attempts long, next_retry_at timestamp"
PENDING = "pending_validation"


def after(status: str, attempts: int, outcome: str, at: pd.Timestamp, most: int) -> tuple[str, int, pd.Timestamp | None]:
    """The state after one more attempt; a settled link stays as it is."""
    if status != PENDING:
        return status, attempts, None
    if outcome in ("valid", "invalid"):
        return ("validated" if outcome == "valid" else "invalid"), attempts, None
    if outcome == "gate":
        return PENDING, attempts, at + pd.Timedelta(seconds=GATE_SECONDS)
    attempts += 1
    if attempts >= most:
        return "error", attempts, None
    wait = min(BACKOFF_CEILING, BACKOFF_BASE << min(max(attempts - 1, 0), BACKOFF_DOUBLINGS))
    return PENDING, attempts, at + pd.Timedelta(seconds=wait)


class LinkState(StatefulProcessor):
    """Folds a link's attempts in order; a timer at its next attempt says that it is due."""

    def __init__(self, key: str, most: int):
        self.key, self.most = key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("link", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        status, attempts, due = held if held else (PENDING, 0, None)
        given = pd.concat(list(rows)).sort_values(["attempt_at", "place"], kind="stable")
        for outcome, at in zip(given["outcome"], given["attempt_at"]):
            if status == PENDING:
                status, attempts, due = after(status, attempts, outcome, pd.Timestamp(at), self.most)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        moment = None if due is None else pd.Timestamp(due).to_pydatetime()
        self.state.update((status, attempts, moment))
        if moment is not None:
            self.handle.registerTimer(max(_millis(moment), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, "state", status, attempts, moment)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, due = self.state.get()
        if status == PENDING:
            yield self._row(key, "due", status, attempts, due)

    def close(self) -> None:
        pass

    def _row(self, key, event: str, status: str, attempts: int, due) -> pd.DataFrame:
        row = {self.key: [key[0]], "event": [event], "status": [status], "attempts": [attempts], "next_retry_at": pd.Series([due], dtype="datetime64[us]")}
        return pd.DataFrame(row)


def _millis(moment: dt.datetime) -> int:
    return int(pd.Timestamp(moment).value // 1_000_000)


def live_link_states(attempts: DataFrame, key: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, event, status, attempts, next_retry_at): the state of each link whenever attempts of it arrive, and, once the
    watermark has passed its next attempt without one, the row ``due``.

    ``attempts``: the key, attempt_at, place (order among attempts of one time), outcome valid, invalid, transient or gate.
    Attempts of one batch are folded in their order; of different batches, in the order of arrival; those behind the
    watermark (the span of the retry budget) do not count. Folded so, the last ``state`` of a link is that of
    ``operators.retry.link_states``. The session has to have the state store of STATE_STORE.
    """
    kind = dict(attempts.dtypes)[key]
    timed = attempts.select(key, attempts["attempt_at"].cast("timestamp").alias("attempt_at"), "place", "outcome").withWatermark("attempt_at", WATERMARK)
    return timed.groupBy(key).transformWithStateInPandas(
        LinkState(key, most), f"`{key}` {kind}, event string, status string, attempts long, next_retry_at timestamp", "update", "eventTime"
    )

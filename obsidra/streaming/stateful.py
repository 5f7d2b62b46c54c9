"""Keyed state that lives as long as it must: budgets with reservations that go stale, and requests that are answered once.

Both keep their state in the session's state store (set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB one) and use
timers in event time, so a restart and a replay give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: what a request key may be.
REQUEST_KEY = re.compile(r"[\x21-\x7e]{1,255}")


def _ms(at: datetime) -> int:
    """Milliseconds of a session-zone (UTC) time."""
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


class BudgetLedger(StatefulProcessor):
    """Settled and held cost of one scope; see :func:`ledger_stream`."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reservations = handle.getMapState("reservations", "id string", "reserved double, since long, settled double, released boolean")
        self.totals = handle.getValueState("totals", "settled double, held double")

    def close(self) -> None:
        pass

    def _held(self, r: tuple, now: int) -> float:
        reserved, since, settled, released = r
        return reserved if reserved is not None and settled is None and not released and now - since <= self.ttl_ms else 0.0

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        settled, held = self.totals.get() if self.totals.exists() else (0.0, 0.0)
        for row in rows:
            name = (row["reservation"],)
            old = tuple(self.reservations.getValue(name)) if self.reservations.containsKey(name) else (None, None, None, False)
            reserved, since, paid, released = old
            larger = lambda x, y: y if x is None else x if y is None else max(x, y)  # noqa: E731  repeated operations count once
            if row["op"] == "reserve":
                reserved, since = larger(reserved, row["amount"]), larger(since, _ms(row["at"]))
                self.handle.registerTimer(max(now, since + self.ttl_ms) + 1)
            elif row["op"] == "settle":
                paid = larger(paid, row["amount"])
            elif row["op"] == "release":
                released = True
            new = (reserved, since, paid, released)
            settled += (paid or 0.0) - (old[2] or 0.0)
            held += self._held(new, now) - self._held(old, now)
            self.reservations.updateValue(name, new)
        self.totals.update((settled, held))
        yield Row(scope=key[0], settled=settled, held=held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Counts anew what is held: a reservation neither settled nor released in time holds nothing."""
        now = timerValues.getCurrentWatermarkInMs()
        settled, before = self.totals.get()
        held = sum(self._held(tuple(r), now) for _, r in self.reservations.iterator())
        if held != before:
            self.totals.update((settled, held))
            yield Row(scope=key[0], settled=settled, held=held)


def ledger_stream(operations: DataFrame, ttl_s: int, late: str = "0 seconds") -> DataFrame:
    """Settled and held cost of each scope after each batch: the batch ledger as of the watermark.

    ``operations``: scope, reservation, op (reserve, settle, release), amount, at. A scope is put out when an operation changes it or
    a reservation of it goes stale.
    """
    stream = operations.withWatermark("at", late)
    return stream.groupBy("scope").transformWithState(
        statefulProcessor=BudgetLedger(ttl_s), outputStructType="scope string, settled double, held double", outputMode="Update", timeMode="EventTime"
    )


class Requests(StatefulProcessor):
    """What is known of one request key; see :func:`answered_once`."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "fingerprint string, response string, until long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["at"], r["op"] != "complete", r["request"])):
            at = _ms(row["at"])
            fingerprint, response, until = self.known.get() if self.known.exists() else (None, None, 0)
            if fingerprint is not None and until <= at:
                self.known.clear()
                fingerprint = None
            outcome = None
            if not REQUEST_KEY.fullmatch(key[0] or ""):
                outcome, response = "invalid", None
            elif row["op"] == "begin" and fingerprint is None:
                outcome, response = "run", None
                self.known.update((row["fingerprint"], None, at + self.ttl_ms))
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), at + self.ttl_ms) + 1)
            elif row["op"] == "begin" and fingerprint != row["fingerprint"]:
                outcome, response = "conflict", None
            elif row["op"] == "begin":
                outcome = "in_progress" if response is None else "replayed"
            elif row["op"] == "complete" and fingerprint is not None and response is None:
                self.known.update((fingerprint, row["response"], until))
            elif row["op"] == "release" and response is None:
                self.known.clear()
            if outcome and (row["op"] == "begin" or outcome == "invalid"):
                yield Row(key=key[0], request=row["request"], outcome=outcome, response=response)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.known.exists() and self.known.get()[2] <= timerValues.getCurrentWatermarkInMs():
            self.known.clear()
        yield from ()


def answered_once(requests: DataFrame, ttl_s: int, late: str = "0 seconds") -> DataFrame:
    """One row per begun request: key, request, outcome, response.

    ``requests``: key, request, op (begin, complete, release), fingerprint, response, at. The first ``begin`` of a key is to ``run``; the
    same fingerprint again is ``replayed`` with the stored response, or ``in_progress`` before there is one; another
    fingerprint is a ``conflict``. A release forgets a request that failed; all is forgotten ``ttl_s`` seconds after
    the first. A key that isn't 1 to 255 printable ASCII characters is ``invalid``.
    """
    stream = requests.withWatermark("at", late)
    return stream.groupBy("key").transformWithState(
        statefulProcessor=Requests(ttl_s), outputStructType="key string, request string, outcome string, response string", outputMode="Append", timeMode="EventTime"
    )

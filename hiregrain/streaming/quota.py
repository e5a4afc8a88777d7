"""The sliding quota as a stateful stream, and its windowed companion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hiregrain.operators.quota import MICROS, WINDOW_SECONDS, seconds_to_wait

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT = 1_000  # milliseconds of event time whose calls of one client are one entry of the state


class QuotaProcessor(StatefulProcessor):
    """Admits the calls of one client in event-time order.

    Calls wait in a map from time slots to the calls of each, and every slot has a timer for its end. When the
    watermark passes it, no call can come before those of the slot any more: they are judged, and their entry goes. A list
    holds the admitted times that still count; a last timer clears it when the newest of them is a window old. So what a batch
    reads and writes of the state are the slots it touches, however many calls wait.
    """

    def __init__(self, per_window: int, window: int, client: str) -> None:
        self.per_window, self.window, self.client = per_window, window, client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "at array<long>, call_id array<long>")
        self.taken = handle.getListState("taken", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, tuple[list[int], list[int]]] = {}
        for batch in rows:
            for at, call in zip(batch["at"], batch["call_id"], strict=True):
                times, calls = fresh.setdefault(int(at) // (SLOT * 1000), ([], []))
                times.append(int(at))
                calls.append(int(call))
        for slot, (times, calls) in fresh.items():
            if self.waiting.containsKey((slot,)):
                held = self.waiting.getValue((slot,))
                times, calls = [*held[0], *times], [*held[1], *calls]
            else:
                self.handle.registerTimer((slot + 1) * SLOT)
            self.waiting.updateValue((slot,), (times, calls))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = now // SLOT - 1
        taken = [row[0] for row in self.taken.get()]
        due: list[tuple[int, int]] = []
        if now % SLOT == 0 and self.waiting.containsKey((slot,)):
            due = sorted(zip(*self.waiting.getValue((slot,))))
            self.waiting.removeKey((slot,))
        waits = []
        for at, _ in due:
            waits.append(seconds_to_wait(taken, at, self.per_window, self.window))
            if waits[-1] is None:
                taken = [*taken, at][-self.per_window :]
        taken = [at for at in taken if now * 1000 - at < self.window]
        if taken:
            self.taken.put([(at,) for at in taken])
            self.handle.registerTimer(-(-(taken[-1] + self.window) // 1000))
        else:
            self.taken.clear()
        if due:
            yield pd.DataFrame(
                {self.client: key[0], "call_id": [call for _, call in due], "at": [at for at, _ in due],
                 "admitted": [w is None for w in waits], "wait": pd.array(waits, dtype="Int32")}
            )

    def close(self) -> None:
        pass


def stream_quota(calls: DataFrame, per_window: int, window_seconds: int = WINDOW_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Admission of every call of a stream ``(client, call_id, ts)`` in event-time order per client.

    A call is judged once the watermark has passed its second, so late calls up to ``delay`` still take their place; later
    ones are dropped by the watermark. Needs the RocksDB state store, which the session is set to.
    """
    calls.sparkSession.conf.set(STATE_STORE, ROCKS)
    kind = dict(calls.dtypes)["client"]
    micros = calls.withWatermark("ts", delay).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return micros.groupBy("client").transformWithStateInPandas(
        QuotaProcessor(per_window, window_seconds * MICROS, "client"), f"client {kind}, call_id long, at long, admitted boolean, wait int", "Append", "EventTime"
    )


def stream_load(calls: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Calls per client in sliding windows."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "client")
        .agg(F.count("*").alias("calls"))
        .select("client", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls")
    )

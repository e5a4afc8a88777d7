"""Per-client call quotas replayed over a log of calls ``(client, call_id, at)``; ``at`` in microseconds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiregrain.plans.skew import top_per_key, with_halo
from hiregrain.session import materialize

MICROS = 1_000_000
WINDOW_SECONDS = 60
DAY = 86_400 * MICROS
DAILY_WAIT = 3600
BLOCK_WINDOWS = 256  # windows of time in which one task looks for idle gaps


def seconds_to_wait(taken: list[int], now: int, limit: int, window: int) -> int | None:
    """None if a call at ``now`` may pass, given the ascending times of the calls that passed before it.

    It may when the ``limit``-th last of them is a whole window old, or when there are not so many.
    """
    if limit < 1:
        raise ValueError("a quota admits at least one call")
    if len(taken) < limit:
        return None
    missing = taken[-limit] + window - now
    return None if missing <= 0 else max(1, -(-missing // MICROS))


def busy_stretches(calls: DataFrame, window: int) -> DataFrame:
    """Add ``_stretch``: the time of the last call before which the client had made no call for a whole window.

    At such a gap no earlier call counts any more, so stretches are independent of each other. Gaps are looked for
    inside blocks of time; blocks only hand on their last call and their last gap, so a busy client spreads over tasks.
    """
    blocked = calls.withColumn("_block", F.floor(F.col("at") / F.lit(window * BLOCK_WINDOWS)))
    inside = Window.partitionBy("client", "_block").orderBy("at", "call_id")
    before = Window.partitionBy("client").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.groupBy("client", "_block").agg(F.max("at").alias("_end"))
    ends = ends.select("client", "_block", F.max("_end").over(before).alias("_earlier"))
    previous = F.coalesce(F.lag("at").over(inside), F.col("_earlier"))
    gap = previous.isNull() | (F.col("at") - previous >= window)
    marked = blocked.join(ends, ["client", "_block"]).withColumn("_gap", F.when(gap, F.col("at"))).drop("_earlier")
    gaps = marked.groupBy("client", "_block").agg(F.max("_gap").alias("_last"))
    gaps = gaps.select("client", "_block", F.max("_last").over(before).alias("_carried"))
    own = F.max("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(gaps, ["client", "_block"]).withColumn("_stretch", F.coalesce(own, F.col("_carried"))).select(*calls.columns, "_stretch")


def sliding_quota(calls: DataFrame, per_window: int, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``(client, call_id, at, admitted, wait)``: at most ``per_window`` admitted calls in any window.

    Whether a call is admitted depends on the calls admitted before it, so the calls between two idle gaps of a client
    form a chain. Chains are dealt out whole, and a task walks through its own with the last ``per_window`` admitted times.
    """
    window = window_seconds * MICROS
    chains = busy_stretches(calls.select("client", "call_id", "at"), window)
    ordered = chains.repartition("client", "_stretch").sortWithinPartitions("client", "_stretch", "at", "call_id")
    kind = dict(calls.dtypes)["client"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, taken = None, []
        for batch in batches:
            waits = []
            for client, stretch, now in zip(batch["client"], batch["_stretch"], batch["at"], strict=True):
                if chain != (client, stretch):
                    chain, taken = (client, stretch), []
                waits.append(seconds_to_wait(taken, now, per_window, window))
                if waits[-1] is None:
                    taken = [*taken[-per_window + 1 :], now] if per_window > 1 else [now]
            yield batch.drop(columns="_stretch").assign(admitted=[w is None for w in waits], wait=pd.array(waits, dtype="Int32"))

    return ordered.mapInPandas(walk, f"client {kind}, call_id long, at long, admitted boolean, wait int")


def capped_quota(calls: DataFrame, per_window: int, per_day: int, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """:func:`sliding_quota` under a cap of ``per_day`` admitted calls a day, all clients together.

    Once a day's cap is reached every further call of that day is refused with :data:`DAILY_WAIT` and leaves no trace in
    its client's window. So the calls after a day's last admitted one are taken out and the rest judged again; a day's
    end only reaches one window into the next day, and passes stop when no day's last call moves any more.
    """
    dated = materialize(calls.select("client", "call_id", "at").withColumn("_day", F.floor(F.col("at") / DAY)))
    at = F.struct("at", "call_id")
    last = None
    while True:
        open_calls = dated if last is None else dated.join(last, "_day", "left").where(F.col("_last").isNull() | (at <= F.col("_last"))).drop("_last")
        judged = materialize(sliding_quota(open_calls, per_window, window_seconds))
        passed = judged.where("admitted").select(F.floor(F.col("at") / DAY).alias("_day"), "at", "call_id")
        ranked = top_per_key(passed, ["_day"], [F.asc("at"), F.asc("call_id")], per_day, "_n").where(F.col("_n") == per_day)
        fresh = materialize(ranked.select("_day", F.struct("at", "call_id").alias("_last")))  # one row per day
        if last is not None and fresh.exceptAll(last).isEmpty() and last.exceptAll(fresh).isEmpty():
            break
        last = fresh
    refused = dated.join(last, "_day").where(at > F.col("_last"))
    return judged.unionByName(refused.select("client", "call_id", "at", F.lit(False).alias("admitted"), F.lit(DAILY_WAIT).alias("wait")))


def offered_load(calls: DataFrame, window_seconds: int = WINDOW_SECONDS, block_seconds: int | None = None) -> DataFrame:
    """Add ``recent``: the client's calls in the trailing window, calls exactly one window old excluded.

    Time is cut into blocks with an overlap of one window, so a busy client spreads over many tasks.
    """
    window = window_seconds * MICROS
    width = max(window, (block_seconds or 60 * window_seconds) * MICROS)
    blocks = with_halo(calls, F.col("at"), width, window)
    trailing = Window.partitionBy("client", "_block").orderBy("at").rangeBetween(-(window - 1), 0)
    return blocks.withColumn("recent", F.count("*").over(trailing)).where("not _copy").drop("_block", "_copy")

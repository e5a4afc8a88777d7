"""Best matches between two tables under a score no equi-join can express.

Both sides are cut into blocks of a fixed size, each a row of its own, and every pair of blocks is one task of fixed size. Spark
hands each task its two blocks from the written tables; no copy of a block is shuffled or stored, so disk grows with the
tables and the results only. A task walks its pair in small parts and keeps only its best ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.plans.skew import top_per_key
from hiregrain.session import materialize, written

QUERY_PART, ITEM_PART = 1_024, 8_192  # rows scored at a time
QUERY_BYTES, ITEM_BYTES = 2 << 20, 32 << 20  # of one block's values; any sizes give the same result
TASKS = 4  # per core at least, if there are as many queries

# (queries, items, k) -> query_id, item_id, score of the k best items of every query. Items below a query's ``floor`` may be left out.
Scorer = Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame]


def best_of(scored: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = scored.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _rows_and_bytes(rows: DataFrame) -> tuple[int, int]:
    kind = dict(rows.dtypes)["value"]
    size: Column = F.size("value") * (4 if kind == "array<float>" else 8) if kind.startswith("array") else F.octet_length("value")
    return rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()


def _blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(key_all, value_all)``: one row per block, each in a partition of its own."""
    kinds = dict(rows.dtypes)
    names = [f"{key}_all", f"{key}_value_all"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is not None:
            columns = [pa.concat_arrays(table.column(c).chunks) for c in (key, "value")]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=names)

    dealt = rows.select(key, "value").repartition(blocks)
    return materialize(dealt.mapInArrow(gather, f"{names[0]} array<{kinds[key]}>, {names[1]} array<{kinds['value']}>"))


def best_matches(
    queries: DataFrame, items: DataFrame, scorer: Scorer, k: int, decimals: int = 12, query_bytes: int = QUERY_BYTES, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``(query_id, item_id, score, rank)`` of the ``k`` best items per query: score down, id up.

    ``queries`` has ``query_id`` and ``value``, ``items`` has ``item_id`` and ``value``. Scores are
    rounded before ranking so that summation order cannot decide a tie. The matches are written, as callers read them more than once.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(items.dtypes)["item_id"]
    asking, query_size = _rows_and_bytes(queries)
    _, item_size = _rows_and_bytes(items)
    item_blocks = max(1, -(-item_size // item_bytes))
    spread = -(-TASKS * queries.sparkSession.sparkContext.defaultParallelism // item_blocks)
    query_blocks = max(1, -(-query_size // query_bytes), min(asking, spread))

    def pair(asked: tuple[pa.Array, pa.Array], held: tuple[pa.Array, pa.Array]) -> Iterator[pd.DataFrame]:
        for start in range(0, len(asked[0]), QUERY_PART):
            q = _frame("query_id", asked, start, QUERY_PART).assign(floor=-np.inf)
            best = None
            for at in range(0, len(held[0]), ITEM_PART):
                found = scorer(q, _frame("item_id", held, at, ITEM_PART), k)
                if len(found):
                    found["score"] = found["score"].round(decimals)
                    best = best_of(found if best is None else pd.concat([best, found]), k)
                    full = best.groupby("query_id")["score"].agg(["min", "size"])
                    q["floor"] = q["query_id"].map(full["min"].where(full["size"] >= k)).fillna(-np.inf)
            if best is not None:
                yield best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, values, held, others = (batch.column(c)[row].values for c in range(4))
                for best in pair((asked, values), (held, others)):
                    columns = [pa.array(best["query_id"], asked.type, from_pandas=True), pa.array(best["item_id"], held.type, from_pandas=True), pa.array(best["score"], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item_id", "score"])

    # Without the hint Spark may broadcast a side; the blocks' sizes are not what it takes them for.
    crossed = _blocks(queries, "query_id", query_blocks).hint("shuffle_replicate_nl").crossJoin(_blocks(items, "item_id", item_blocks))
    local = crossed.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return written(top_per_key(local, ["query_id"], [F.desc("score"), F.asc("item_id")], k))


def _frame(key: str, block: tuple[pa.Array, pa.Array], start: int, rows: int) -> pd.DataFrame:
    return pd.DataFrame({key: block[0].slice(start, rows).to_pandas(), "value": block[1].slice(start, rows).to_pandas()})

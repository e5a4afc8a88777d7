"""Exact top-k inner products by columnar branch-and-bound.

Vectors are stored vertically, one row per dimension, in blocks of candidates. For one query the dimensions are taken
in blocks, those where the query has most of its mass first. After a block every candidate has a partial score and an
upper bound: the partial score plus the product of what is left of the two norms. Candidates whose bound is below the
k-th best score known so far are compacted away before the next block is read.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither as query nor as
candidate; only vectors of one length are compared; a query's own row is no candidate for it; rows that repeat an id
are candidates of their own; ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2_048  # with the next: what one task holds
CANDIDATE_BLOCK = 16_384
DIMENSIONS = 16


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, taken as double; null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, width: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query: the positions and scores of its k best candidates among ``columns`` (dimensions x candidates).

    ``ids`` ascend. Scores are exact in 64-bit integers; bounds are widened by their rounding error.
    """
    dims, total = columns.shape
    energy = np.square(columns.astype(np.float64))
    norms = energy.sum(axis=0)
    for number in range(len(queries)):
        query = queries[number]
        order = np.argsort(-np.abs(query), kind="stable")
        alive = np.flatnonzero(ids != query_ids[number])
        score = np.zeros(len(alive), np.int64)
        left = norms[alive]
        mass = np.square(query.astype(np.float64))[order]
        for start in range(0, dims, width):
            block = order[start : start + width]
            part = columns[block] if len(alive) == total else columns[np.ix_(block, alive)]
            score = score + query[block] @ part
            rest = float(mass[start + width :].sum())
            if rest == 0.0 or len(alive) <= k:
                continue
            left = np.maximum(left - (energy[block] if len(alive) == total else energy[np.ix_(block, alive)]).sum(axis=0), 0.0)
            reach = np.sqrt(rest) * np.sqrt(left) * (1 + 1e-9) + 1e-3 * (1 + np.sqrt(norms[alive]) * 1e-6)
            floor = np.partition(score - reach, len(alive) - k)[len(alive) - k]  # k candidates score this much at least
            stay = score + reach >= floor
            if not stay.all():
                alive, score, left = alive[stay], score[stay], left[stay]
        best = np.lexsort((ids[alive], -score))[:k]
        yield number, alive[best], score[best]


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def top_k(vectors: DataFrame, query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's id and its score, for the rows where ``query`` is true.

    Queries and candidates are dealt to blocks by the hash of their row; every pair of a query block and a candidate block
    is one task of fixed size, so candidates are copied once per ``QUERY_BLOCK`` queries.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    rows = rows.where("v is not null and id is not null").withColumn("d", F.size("v"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    candidate_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    def spread(blocks: int) -> Column:
        return F.sequence(F.lit(0), F.lit(blocks - 1))

    place = F.xxhash64("id", "v")
    asking = rows.where("q").select("id", "v", "d", F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb"), F.explode(spread(candidate_blocks)).alias("cb"))
    given = rows.select("id", "v", "d", F.pmod(place, F.lit(candidate_blocks)).cast("int").alias("cb"), F.explode(spread(query_blocks)).alias("qb"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            right = right.sort_by([("id", "ascending")])
            ids = right.column("id").to_numpy()
            columns = np.ascontiguousarray(_vectors(right).T)
            query_ids = left.column("id").to_numpy()
            for number, at, score in best_of_block(_vectors(left), query_ids, columns, ids, k):
                out[0].append(np.full(len(at), query_ids[number]))
                out[1].append(ids[at])
                out[2].append(score)
        parts = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table({"query_id": parts[0].astype(np.int64), "other": parts[1].astype(np.int64), "score": parts[2].astype(np.int64)})

    keys = ["qb", "cb", "d"]
    found = asking.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(work, "query_id long, other long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("other").alias(id_column), "score")

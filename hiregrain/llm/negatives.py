"""Hard negatives by exact scores from a residue number system.

The score of two vectors is the inner product of their quantised components. Integer matrices are slow to multiply and
float matrices round, so the components are taken modulo several small primes first. A prime's residues are so small that
a float32 matrix product of :data:`SLICE` dimensions is an exact integer; slices are added up modulo the prime. The score is
then rebuilt from its residues by Chinese remaindering (Garner's mixed radix with balanced digits), which is exact once
the primes' product exceeds twice the largest score that the norms in a block allow. So many primes are taken, and no more.

Two passes select: an anchor is scored against the rows of its own label, whose best become its positives; then against the
rows of other labels, of which every positive keeps the best ones inside a window around its own score. Both are block
products: rows are dealt to blocks of fixed size by their hash, a pair of blocks is one task, and a task hands on at most k
rows an anchor. A label that holds most rows is as many blocks as any other rows would be.

Defined results: rows with a null id, a null label, or a vector that is null, empty, or holds null or non-finite
components take no part. Only vectors of one length are compared. Ties go to the smaller id. A row is never its own
positive, nor is another row of its id. Of rows that repeat an anchor's id the least (label, vector) asks; as candidates such
rows count one by one. Anchors without positives, and positives without a negative inside the window, give no rows; a
negative positive score leaves the window empty. Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.search import quantised
from hiregrain.plans.skew import top_per_key
from hiregrain.session import materialize

ANCHOR_BLOCK, CANDIDATE_BLOCK = 8_192, 8_192  # with the next: what one task holds
ANCHOR_SLICE = 64
SLICE = 64  # dimensions of one float32 product
EXACT = 1 << 24  # float32 holds every integer up to here
KEYS = ["_d", "_ab", "_cb"]


def primes_for(bound: int) -> list[int]:
    """The largest primes whose residue products stay exact over a slice, until their product exceeds ``2 * bound``."""
    largest = 2 * math.isqrt((EXACT - 1) // SLICE) + 1
    chosen: list[int] = []
    for p in range(largest, 2, -2):
        if math.prod(chosen) > 2 * bound:
            return chosen
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            chosen.append(p)
    raise ValueError("scores of this size don't fit 64 bits")


def _balanced(values: np.ndarray, p: int) -> np.ndarray:
    """``values`` modulo ``p``, between ``-(p - 1) / 2`` and ``(p - 1) / 2``."""
    half = (p - 1) // 2
    return (values + half) % p - half


class ResidueMatrix:
    """Integer rows, split into one float32 matrix per prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]) -> None:
        self.primes = primes
        self.parts = [_balanced(rows, p).astype(np.float32) for p in primes]

    def products(self, other: ResidueMatrix) -> np.ndarray:
        """The exact inner products of all rows here with all rows there, in 64-bit integers."""
        residues = []
        for p, left, right in zip(self.primes, self.parts, other.parts):
            total = np.zeros((len(left), len(right)), np.int32)
            for start in range(0, left.shape[1], SLICE):
                total = _balanced(total + (left[:, start : start + SLICE] @ right[:, start : start + SLICE].T).astype(np.int32), p)
            residues.append(total)
        return rebuild(residues, self.primes)


def rebuild(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers below half the primes' product that have these residues."""
    digits: list[np.ndarray] = []
    for p, rest in zip(primes, residues):
        for q, digit in zip(primes, digits):
            rest = _balanced(_balanced(rest - digit, p) * pow(q, -1, p), p)
        digits.append(rest)
    value, weight = np.zeros(residues[0].shape, np.int64), 1
    for p, digit in zip(primes, digits):
        value += digit.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))  # sums wrap, the value itself fits
        weight *= p
    return value


def _rows(table: pa.Table, name: str = "v") -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_blocks(anchors: pa.Table, candidates: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of all candidates for the anchors from a position on, some anchors at a time."""
    left, right = _rows(anchors), _rows(candidates)
    norms = [float(np.square(x.astype(np.float64)).sum(axis=1).max()) for x in (left, right)]
    primes = primes_for(min(int(math.sqrt(norms[0]) * math.sqrt(norms[1]) * (1 + 1e-9)) + 1, (1 << 63) - 1))
    there = ResidueMatrix(right, primes)
    for start in range(0, len(left), ANCHOR_SLICE):
        yield start, ResidueMatrix(left[start : start + ANCHOR_SLICE], primes).products(there)


def _output(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def best_positives(anchors: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The ``k`` best candidates of every anchor, all of its label."""
    out = []
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by([("id", "ascending")])
        asked, ids = anchors.column("id").to_numpy(), candidates.column("id").to_numpy()
        for start, scores in score_blocks(anchors, candidates):
            for row, score in enumerate(scores, start):
                others = np.flatnonzero(ids != asked[row])
                best = others[np.argsort(-score[others], kind="stable")[:k]]
                out.append((np.full(len(best), asked[row]), ids[best], score[best]))
    return _output(out, ["anchor_id", "positive_id", "positive_score"])


def windowed_negatives(anchors: pa.Table, candidates: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For every positive of every anchor the ``k`` best candidates of other labels inside the window around its score."""
    out = []
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by([("id", "ascending")])
        asked, own = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        ids, labels = candidates.column("id").to_numpy(), candidates.column("label").to_numpy()
        positives = anchors.column("positives").to_pylist()
        for start, scores in score_blocks(anchors, candidates):
            for row, score in enumerate(scores, start):
                windows = [(p["rank"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in positives[row]]
                inside = np.flatnonzero((labels != own[row]) & (score >= min(w[1] for w in windows)) & (score <= max(w[2] for w in windows)))
                inside = inside[np.argsort(-score[inside], kind="stable")]
                falling = -score[inside]
                for rank, floor, ceiling in windows:
                    first = int(np.searchsorted(falling, -ceiling, "left"))
                    last = min(int(np.searchsorted(falling, -floor, "right")), first + k)
                    if first < last:
                        chosen = inside[first:last]
                        out.append((np.full(len(chosen), asked[row]), np.full(len(chosen), rank), ids[chosen], score[chosen]))
    return _output(out, ["anchor_id", "positive_rank", "negative_id", "negative_score"])


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size).cast("int"))


def _dealt(df: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Every row in its block, once for each block of the other side."""
    place = F.pmod(F.xxhash64("id", "v", F.lit("block")), own_blocks).cast("int")
    df = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides come from the same rows: told apart
    return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1)))


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, both scores and ``positive_rank`` for the rows where ``anchor`` is true.

    A negative's score lies between ``window`` percent of the positive's. ``rank`` counts the negatives of one positive.
    """
    low, high = window
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        quantised(F.col(vector), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("q"),
    ).where("id is not null and label is not null and v is not null").withColumn("_d", F.size("v"))
    asking = rows.where("q").groupBy("id").agg(F.min(F.struct("label", "v", "_d")).alias("_row")).select("id", "_row.*")

    sizes = rows.groupBy("_d", "label").agg(F.count("*").alias("_n"), F.count_if("q").alias("_asked")).where("_asked > 0")
    blocks = sizes.select("_d", "label", _blocks(F.col("_n"), CANDIDATE_BLOCK).alias("_cbs"), _blocks(F.col("_asked"), ANCHOR_BLOCK).alias("_abs"))
    alike = [*KEYS, "label"]
    left = _dealt(asking.join(blocks, ["_d", "label"]), "_ab", F.col("_abs"), "_cb", F.col("_cbs")).select("id", "v", *alike)
    right = _dealt(rows.join(blocks, ["_d", "label"]), "_cb", F.col("_cbs"), "_ab", F.col("_abs")).select("id", "v", *alike)
    found = left.groupBy(*alike).cogroup(right.groupBy(*alike)).applyInArrow(
        lambda a, c: best_positives(a, c, positives), "anchor_id long, positive_id long, positive_score long"
    )
    chosen = materialize(top_per_key(found, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives, "positive_rank"))

    lists = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_rank").alias("rank"), F.col("positive_score").alias("score"))).alias("positives"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    cbs, abs_ = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // ANCHOR_BLOCK))
    left = _dealt(asking.join(lists, "id"), "_ab", F.lit(abs_), "_cb", F.lit(cbs)).select("id", "label", "v", "positives", *KEYS)
    right = _dealt(rows, "_cb", F.lit(cbs), "_ab", F.lit(abs_)).select("id", "label", "v", *KEYS)
    inside = left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(
        lambda a, c: windowed_negatives(a, c, negatives, low, high), "anchor_id long, positive_rank long, negative_id long, negative_score long"
    )
    ranked = top_per_key(inside, ["anchor_id", "positive_rank"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    scored = ranked.join(chosen.withColumn("positive_rank", F.col("positive_rank").cast("long")), ["anchor_id", "positive_rank"])
    return scored.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))

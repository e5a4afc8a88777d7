"""Rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators.dense import dense_top_k
from hiregrain.operators.keyword import bm25_top_k
from hiregrain.plans.skew import top_per_key

RRF_K = 60
CANDIDATES = 20


def reciprocal_rank_fusion(
    rankings: Sequence[DataFrame], k: int | None = None, rrf_k: int = RRF_K, payload: Sequence[str] = ()
) -> DataFrame:
    """Fuse ``(query_id, doc_id, rank, *payload)`` rankings: ``(query_id, doc_id, score, best_rank, *payload, rank)``.

    A document repeated within one ranking counts once, at its best position; the first ranking that
    holds it provides the payload. Order: score down, best rank up, id up.
    """
    columns = ["query_id", "doc_id", "rank", *payload]
    tagged = [r.select(*columns, F.lit(i).alias("_source")) for i, r in enumerate(rankings)]
    united = tagged[0]
    for other in tagged[1:]:
        united = united.unionByName(other)
    once = united.groupBy("query_id", "doc_id", "_source").agg(
        F.min("rank").alias("rank"), *[F.min_by(c, "rank").alias(c) for c in payload]
    )
    fused = once.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 12).alias("score"),
        F.min("rank").alias("best_rank"),
        *[F.min_by(c, "_source").alias(c) for c in payload],
    )
    order = [F.desc("score"), F.asc("best_rank"), F.asc("doc_id")]
    return top_per_key(fused, ["query_id"], order, k if k is not None else 2**31 - 1)


def hybrid_search(
    queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int, candidates: int = CANDIDATES,
    tokenizer=T.tokens, within: DataFrame | None = None,
) -> DataFrame:
    """BM25 and cosine rankings of ``max(k, candidates)`` documents each, fused and cut to ``k``.

    ``within`` (see :func:`matching_documents`) filters before either ranking is cut.
    """
    depth = max(k, candidates)
    keyword = bm25_top_k(queries, docs, depth, tokenizer, within)
    dense = dense_top_k(query_vectors, vectors, depth, within)
    return reciprocal_rank_fusion([keyword, dense], k)


def matching_documents(payload: DataFrame, *conditions) -> DataFrame:
    """Ids of the documents whose payload satisfies every condition (a Column over payload columns).

    Hand them to a search as ``within``: a filter after the cut to ``k`` would lose hits.
    """
    wanted = payload
    for condition in conditions:
        wanted = wanted.where(condition)
    return wanted.select("doc_id").distinct()


def passage_pairs(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, doc_id, rank, chunk_no, passage)`` for every passage of every candidate."""
    return candidates.select("query_id", "doc_id", "rank").join(chunks.select("doc_id", "chunk_no", "passage"), "doc_id")


def rerank_by_best_passage(candidates: DataFrame, passage_scores: DataFrame) -> DataFrame:
    """A candidate's score is its best passage's; ties keep the earlier order; no candidate is lost."""
    best = passage_scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rerank_by_score(candidates, best)


def rerank_by_score(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Reorder by an external score: score down, original rank, id; unscored candidates come last."""
    joined = candidates.select("query_id", "doc_id", F.col("rank").alias("original_rank")).join(
        scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left"
    )
    order = [F.desc_nulls_last("score"), F.asc("original_rank"), F.asc("doc_id")]
    return top_per_key(joined, ["query_id"], order, 2**31 - 1)


def rerank_by_overlap(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Score candidates by the number of distinct query words in the document; ties by id."""
    wanted = queries.select("query_id", F.array_distinct(T.words("text")).alias("_q"))
    # Only candidates are cut into words; a document's words are reduced to its distinct set before they travel.
    present = docs.join(candidates.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.words("text")).alias("_d"))
    scored = (
        candidates.select("query_id", "doc_id")
        .join(wanted, "query_id")
        .join(present, "doc_id")
        .select("query_id", "doc_id", F.size(F.array_intersect("_q", "_d")).cast("double").alias("score"))
    )
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], 2**31 - 1)


def rerank_mismatches(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """``(query_id, doc_id, problem)`` where reranking lost, invented or repeated a document."""
    asked = candidates.groupBy("query_id", "doc_id").agg(F.count("*").alias("_a"))
    got = reranked.groupBy("query_id", "doc_id").agg(F.count("*").alias("_g"))
    problem = (
        F.when(F.col("_a").isNull(), "extra").when(F.col("_g").isNull(), "missing").when(F.col("_g") > 1, "duplicate")
    )
    return (
        asked.join(got, ["query_id", "doc_id"], "full_outer")
        .withColumn("problem", problem)
        .where("problem is not null")
        .select("query_id", "doc_id", "problem")
    )


def require_same_documents(candidates: DataFrame, reranked: DataFrame) -> None:
    first = rerank_mismatches(candidates, reranked).first()
    if first is not None:
        raise ValueError(f"reranking returned a {first.problem} document: query {first.query_id}, document {first.doc_id}")

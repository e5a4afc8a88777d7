"""BM25 for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.plans.skew import top_per_key
from hiregrain.session import materialize, written

K1, B = 1.5, 0.75
SCORE_DECIMALS = 9
SCORES = 500_000  # (query, document) pairs of one task; any value gives the same result
# Stands for "the document itself" among its tokens; never produced by a tokenizer.
DOCUMENT = ""


def corpus_statistics(docs: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return docs.agg(F.count("*").alias("documents"), F.avg(F.size(tokenizer("text"))).alias("average_length"))


def document_frequency(docs: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """``(token, df)``. Tokens are made distinct inside the document's row, so no (token, document) shuffle."""
    return (
        docs.select(F.explode_outer(F.array_distinct(tokenizer("text"))).alias("token"))
        .where("token is not null")
        .groupBy("token")
        .agg(F.count("*").alias("df"))
    )


def query_terms(queries: DataFrame, tokenizer=T.tokens) -> DataFrame:
    return (
        queries.select("query_id", F.explode_outer(tokenizer("text")).alias("token"))
        .where("token is not null")
        .groupBy("query_id", "token")
        .agg(F.count("*").alias("qf"))
    )


def bm25_scores(queries: DataFrame, docs: DataFrame, tokenizer=T.tokens, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document sharing a token with a query.

    The corpus is tokenized once and only tokens that some query uses leave the scan. They are placed
    by document, in as many parts as keep a part's scores at about ``SCORES``, and counted into a term table that is
    written out. What is written loses its placement, so the counted terms are dealt by document again, into the same
    number of parts: where the query side is shipped to them, sums are made inside a part, no score is shuffled, and a
    part holds about ``SCORES`` of them however many documents there are. Corpus statistics come from the same table
    through one extra token per document. The query side is written with its true size; whether a join ships it is left
    to Spark's own threshold.
    """
    terms = written(query_terms(queries, tokenizer))
    marker = queries.sparkSession.range(1).select(F.lit(DOCUMENT).alias("token"))
    vocabulary = written(terms.select("token").unionByName(marker).distinct())
    scores = docs.count() * terms.select("query_id").distinct().count()
    parts = max(queries.sparkSession.sparkContext.defaultParallelism, -(-scores // SCORES))
    # explode_outer, because plain explode infers a filter that would tokenize every text again;
    # the array always holds the marker.
    placed = (
        docs.select("doc_id", tokenizer("text").alias("_t"))
        .select("doc_id", F.size("_t").alias("dl"), F.array_append("_t", DOCUMENT).alias("_t"))
        .select("doc_id", "dl", F.explode_outer("_t").alias("token"))
        .join(vocabulary, "token", "left_semi")
        .repartition(parts, "doc_id")
    )
    frequencies = materialize(placed.groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf")))
    by_token = written(frequencies.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("_len")))
    document = F.col("token") == DOCUMENT
    corpus = by_token.agg(
        F.struct(
            F.max(F.when(document, F.col("df"))).alias("n"),
            F.max(F.when(document, F.col("_len") / F.col("df"))).alias("avg"),
        ).alias("c")
    ).scalar()
    idf = F.log(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(terms.join(by_token, "token").select("query_id", "token", (F.col("qf") * idf).alias("weight")))
    tf = F.col("tf")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / corpus["avg"]))
    return (
        frequencies.repartition(parts, "doc_id")
        .join(weights, "token")
        .groupBy("doc_id", "query_id")
        .agg(F.round(F.sum(part), SCORE_DECIMALS).alias("score"))
        .select("query_id", "doc_id", "score")
    )


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, tokenizer=T.tokens, within: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents per query: score down, id up. No tokens or no documents, no rows.

    With ``within`` (``doc_id``) only those documents are ranked; corpus statistics stay those of all documents.
    The hits are written with their true size, as callers read them more than once and join them with texts, which then need no shuffle.
    """
    scores = bm25_scores(queries, docs, tokenizer)
    if within is not None:
        scores = scores.join(within.select("doc_id"), "doc_id", "left_semi")
    return written(top_per_key(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k))


def with_extra_terms(extra) -> object:
    """A tokenizer that adds ``extra(text)`` (an array column) on top of the regular tokens."""

    def tokenizer(text: Column | str) -> Column:
        return F.concat(T.tokens(text), F.coalesce(extra(text), F.array().cast("array<string>")))

    return tokenizer

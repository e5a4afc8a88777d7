"""BM25 top-k over a stored index, exact, reading only blocks of documents that can matter.

The index is written once. Documents are dealt to blocks of similar ones: those with the same most frequent token (which tells
languages and subjects apart) and about the same length. A term table holds one row per (token, block): the documents of the
block that hold the token, each with its impact, and the largest of these impacts. A document's score is the sum of its
impacts, weighted by the query's terms; so the weighted sum of a block's largest impacts bounds the scores of all its documents.

A search reads the narrow columns first and bounds every (query, block). The most promising blocks are scored, which gives each
query a k-th best score to beat; then only those blocks are read whose bound reaches it. No text is read or cut
into tokens but the queries'. Corpus statistics are those of the indexed documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators.keyword import K1, SCORE_DECIMALS, B, query_terms
from hiregrain.plans.skew import top_per_key
from hiregrain.session import materialize, written

BLOCK = 64  # documents
BUCKETS = 32  # by token; a file holds its buckets in order
SCORES = 500_000  # (query, document) pairs, or terms of documents, of one task; any value gives the same result
FEW = 10_000  # blocks of which a list may be broadcast; any value gives the same result
SLACK = 1e-6  # more than rounding and the order of a sum can make


def term_counts(tokens: Column) -> Column:
    """``array<struct<token, tf>>`` of a row's tokens, counted in the row: sorted, then cut where the token changes."""

    def cut(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return T.let(starts, lambda s: F.transform(s, lambda x, j: F.struct(F.get(ordered, x).alias("token"), (F.coalesce(F.get(s, j + 1), last + 1) - x).alias("tf"))))

    return T.let(F.array_sort(tokens), cut)


def _most_frequent(counts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(counts, lambda c: F.struct(c.tf, c.token))).token, F.lit(""))


@dataclass(frozen=True)
class KeywordIndex:
    """An index written to ``folder``: ``postings``, a document's block in ``placement``, ``terms`` and, written last, ``corpus``."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def corpus(self) -> DataFrame:
        """One row: ``documents``, ``average_length``, ``k1``, ``b``."""
        return self._table("corpus")

    def terms(self) -> DataFrame:
        """``token``, its ``bucket`` and ``df``."""
        return self._table("terms")

    def postings(self) -> DataFrame:
        """``bucket``, ``token``, ``block``, ``impact`` (the block's largest) and ``entries`` (``doc_id``, ``impact``)."""
        kind = self._table("documents").schema["doc_id"].dataType.simpleString()
        return self.spark.read.schema(f"token string, block long, impact double, entries array<struct<doc_id:{kind},impact:double>>, bucket int").parquet(f"{self.folder}/postings")

    def weights(self, queries: DataFrame, tokenizer=T.tokens) -> DataFrame:
        """``(query_id, bucket, token, weight)`` of the queries' terms that some document holds, written with their true size."""
        n = self.corpus().select("documents").scalar()
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return written(query_terms(queries, tokenizer).join(self.terms(), "token").select("query_id", "bucket", "token", (F.col("qf") * idf).alias("weight")))

    def _placed(self, weights: DataFrame, parts: int, column: str, blocks: DataFrame | None = None) -> DataFrame:
        """The queries' tokens' postings, placed by block; what is made of them there stays there. With ``blocks`` only theirs."""
        asked = weights.select("bucket", "token").distinct()
        postings = self.postings().join(asked, ["bucket", "token"], "left_semi").select("token", "block", column)
        if blocks is not None:
            postings = postings.join(F.broadcast(blocks.select("block")), "block", "left_semi")
        return postings.repartition(parts, "block")

    def bounds(self, weights: DataFrame) -> DataFrame:
        """``(query_id, block, bound)``: no document of the block scores more for the query."""
        parts = _parts(weights, self._table("placement").select("block").distinct().count() * weights.select("query_id").distinct().count())
        met = self._placed(weights, parts, "impact").join(weights, "token")
        return met.groupBy("block", "query_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"))

    def scores(self, chosen: DataFrame, weights: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """``(query_id, doc_id, score)`` of all documents in the chosen ``(query_id, block)`` that share a token with the query.

        All rows of a document are in one block, so sums are made where its postings are: neither parts nor scores are shuffled.
        """
        parts = _parts(weights, chosen.count() * BLOCK)
        opened = chosen.groupBy("block").agg(F.collect_set("query_id").alias("_asking"))
        if within is not None:
            inside = self._table("placement").join(within.select("doc_id"), "doc_id", "left_semi")
            opened = opened.join(inside.groupBy("block").agg(F.collect_set("doc_id").alias("_inside")), "block")
        opened = written(opened)
        few = opened if opened.count() <= FEW else None
        met = self._placed(weights, parts, "entries", few).join(opened.repartition(parts, "block"), "block")
        if within is not None:
            met = met.withColumn("entries", F.filter("entries", lambda e: F.array_contains("_inside", e.doc_id)))
        asked = met.join(weights.select("query_id", "token", "weight"), "token").where(F.array_contains("_asking", F.col("query_id")))
        entries = asked.select("block", "query_id", "weight", F.explode("entries").alias("e"))
        summed = entries.groupBy("block", "query_id", "e.doc_id").agg(F.round(F.sum(F.col("weight") * F.col("e.impact")), SCORE_DECIMALS).alias("score"))
        return summed.select("query_id", "doc_id", "score")

    def plan(self, queries: DataFrame, k: int, tokenizer=T.tokens, within: DataFrame | None = None) -> tuple[DataFrame, ...]:
        """The terms' weights, all bounds, the blocks scored ``first``, the best of those, and the other blocks that must be read."""
        weights = self.weights(queries, tokenizer)
        bounds = materialize(self.bounds(weights))
        first = materialize(top_per_key(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], 1 + -(-2 * k // BLOCK)).select("query_id", "block"))
        best = materialize(_best(self.scores(first, weights, within), k))
        floor = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        open_blocks = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
        return weights, bounds, first, best, materialize(open_blocks.select("query_id", "block").join(first, ["query_id", "block"], "left_anti"))

    def top_k(self, queries: DataFrame, k: int, tokenizer=T.tokens, within: DataFrame | None = None) -> DataFrame:
        """``(query_id, doc_id, score, rank)``: the best ``k`` documents per query, score down, id up.

        With ``within`` (``doc_id``) only those documents are ranked.
        """
        weights, _, _, best, rest = self.plan(queries, k, tokenizer, within)
        return _best(best.drop("rank").unionByName(self.scores(rest, weights, within)), k)

    def skipped(self, queries: DataFrame, k: int, tokenizer=T.tokens) -> DataFrame:
        """Per query: the ``blocks`` that share a token with it, and how many of them a search for ``k`` reads."""
        _, bounds, first, _, rest = self.plan(queries, k, tokenizer)
        read = first.unionByName(rest).groupBy("query_id").agg(F.count("*").alias("blocks_read"))
        return bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")


def _parts(weights: DataFrame, scores: int) -> int:
    return max(weights.sparkSession.sparkContext.defaultParallelism, -(-scores // SCORES))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_per_key(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def write_index(docs: DataFrame, folder: str, tokenizer=T.tokens, k1: float = K1, b: float = B, block: int = BLOCK, buckets: int = BUCKETS) -> KeywordIndex:
    """Index ``doc_id`` and ``text``. Texts are read once; what is shuffled are terms with their counts, once, by block."""
    spark = docs.sparkSession
    # Each step reads what the one before made more than once, so Spark keeps them apart and cuts every text into tokens once.
    cut = docs.where("text is not null").select("doc_id", tokenizer("text").alias("tokens"))
    counted = cut.select("doc_id", F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("terms"))
    kind = F.struct(_most_frequent(F.col("terms")).alias("top"), F.floor(F.log2(F.col("dl") + 1)).cast("int").alias("magnitude"))
    counted.withColumn("kind", kind).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/documents")
    counted = spark.read.parquet(f"{folder}/documents")
    average = counted.agg(F.avg("dl").alias("average_length")).scalar()
    # All rows of an id that is repeated, with other texts too, go to one block.
    repeated = written(counted.groupBy("doc_id").agg(F.min("kind").alias("_kind"), F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), "_kind"))
    kept = counted.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_id", "_kind")
    # One row per token and magnitude at most; written with its true size, or the documents would be shuffled by kind to meet it.
    kinds = written(kept.groupBy("kind").agg(F.ceil(F.count("*") / block).alias("_blocks")))
    split = F.pmod(F.xxhash64("doc_id"), F.col("_blocks"))
    placed = kept.join(kinds, "kind").withColumn("block", F.xxhash64("kind", split))
    placed.select("doc_id", "block").distinct().write.mode("overwrite").parquet(f"{folder}/placement")
    # A document's terms travel as two lists, a token each and a number each, and are taken apart where its block is.
    parts = max(spark.sparkContext.defaultParallelism, -(-(counted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // SCORES)))
    lists = placed.select("doc_id", "dl", "block", F.col("terms.token").alias("_tokens"), F.col("terms.tf").alias("_counts")).repartition(parts, "block")
    dealt = lists.select("doc_id", "dl", "block", F.inline(F.arrays_zip(F.col("_tokens").alias("token"), F.col("_counts").alias("tf"))).alias("token", "tf"))
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / average)
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    postings = dealt.groupBy("block", "token").agg(F.max(impact).alias("impact"), F.collect_list(F.struct("doc_id", impact.alias("impact"))).alias("entries"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")
    ordered = postings.select("token", "block", "impact", "entries", bucket).sortWithinPartitions("bucket", "token", "block")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings")
    index = KeywordIndex(spark, folder)
    terms = index.postings().groupBy("bucket", "token").agg(F.sum(F.size("entries")).alias("df"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    corpus = counted.agg(F.count("*").alias("documents"), F.avg("dl").alias("average_length"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")
    return index


def open_index(spark: SparkSession, folder: str) -> KeywordIndex | None:
    """The index in ``folder``; None if there is none or if its writing was never finished."""
    index = KeywordIndex(spark, folder)
    try:
        index.corpus()
        index._table("placement")
    except AnalysisException:
        return None
    return index

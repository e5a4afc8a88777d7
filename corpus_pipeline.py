"""A corpus, cleaned and packed: five stages, each written as Parquet and read again for the next.

Every stage works on all documents that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiregrain.llm import lines, packing, pii, simhash, toxicity
from hiregrain.llm.checks import BYTE_BPE, vocabulary
from hiregrain.llm.common import whole
from hiregrain.session import ensure_checkpoint_dir, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_BITS = 5  # of 64


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), lexicon, keep_text=True).where("predicted = 0").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    return _measured(lines.dedup_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: SimHash of five-word shingles, fingerprints linked at ``NEAR_BITS`` or fewer differing bits.

    It is the one with the smallest id; one without an id only if no member has one, and of several with the id that
    whose text has the smallest hash. Of rows that agree in both, the one with the smallest other columns stays.
    """
    rows = materialize(simhash.near_rows(docs, words_per_shingle=5, max_bits=NEAR_BITS))
    pairs = rows.groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("_n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key", "_n")).alias("_first")
    kept = materialize(pairs.groupBy("group").agg(first).select("_first.*"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_n")
    keyed = docs.select(*COLUMNS, F.xxhash64(whole("text")).alias("_text_key"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    alone = keyed.join(kept.where("_n = 1"), here, "left_semi").select(*COLUMNS)
    repeated = kept.where("_n > 1")
    if repeated.isEmpty():
        return alone
    folded = keyed.join(repeated, here, "left_semi").groupBy("doc_id", "_text_key").agg(F.min(F.struct(*COLUMNS)).alias("_row"))
    return alone.unionByName(folded.select("_row.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _measured(pii.redact(docs.select(*COLUMNS), pii.learn(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack_documents(docs, vocabulary(BYTE_BPE))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]
# Learned weights, fingerprints, trained spans and token ids can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage returns is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

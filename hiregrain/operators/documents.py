"""Search documents, passages, and the incremental vector index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.functions import pandas_udf

from hiregrain.functions import text as T

UNSPECIFIED = "Not specified"
DESCRIPTION = "\nDescription: "
MAX_WORDS, OVERLAP_WORDS, MAX_CHUNKS = 200, 40, 4  # fixed values; ``None`` for chunks keeps the whole text


def skill_lists(job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """``(job_id, required_skills, preferred_skills)``: distinct names in case-insensitive order."""
    named = (
        job_skills.where(F.col("requirement_type").isin("required", "preferred"))
        .select("job_id", "skill_id", "requirement_type")
        .distinct()
        .join(skills.select(F.col("id").alias("skill_id"), "canonical_name"), "skill_id")
    )

    def names(kind: str) -> Column:
        kept = F.collect_set(F.when(F.col("requirement_type") == kind, F.struct(T.casefold("canonical_name").alias("k"), F.col("canonical_name").alias("n"))))
        return F.transform(F.array_sort(kept), lambda x: x["n"])

    return named.groupBy("job_id").agg(names("required").alias("required_skills"), names("preferred").alias("preferred_skills"))


def search_documents(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """``(job_id, title, text, document_hash, payload...)`` for every posting."""
    named = jobs.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left").join(
        skill_lists(job_skills, skills), F.col("id") == F.col("job_id"), "left"
    ).drop("job_id")
    empty = F.array().cast("array<string>")
    named = named.withColumn("required_skills", F.coalesce("required_skills", empty)).withColumn(
        "preferred_skills", F.coalesce("preferred_skills", empty)
    )

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit(UNSPECIFIED)))

    text = F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Title: "), F.col("title")),
            line("Location", F.col("location")),
            line("Employment type", F.col("employment_type")),
            line("Required skills", F.array_join("required_skills", ", ")),
            line("Preferred skills", F.array_join("preferred_skills", ", ")),
        ),
        F.lit(DESCRIPTION),
        F.col("description"),
    )
    built = named.withColumn("text", text)
    return built.select(
        F.col("id").alias("job_id"), "title", "text", T.sha_hex("text").alias("document_hash"), "company", "location",
        "employment_type", "experience_years_min", "required_skills", "preferred_skills", "content_hash",
    )


def pack_sentences(text: str, max_words: int, overlap: int) -> list[str]:
    """Windows of whole sentences of at most ``max_words`` words, sharing trailing sentences."""
    pieces = []
    for sentence in re.split(r"(?<=[.!?;])\s+", text.strip()):
        words = sentence.split()
        pieces += [words[i : i + max_words] for i in range(0, len(words), max_words)]
    sizes = [len(p) for p in pieces]
    windows, start, total = [], 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > max_words:
            windows.append((start, at))
            low, start, total = start, at, 0
            while start > low and total + sizes[start - 1] <= overlap:
                start -= 1
                total += sizes[start]
        total += size
    if pieces:
        windows.append((start, len(pieces)))
    return [" ".join(word for piece in pieces[a:b] for word in piece) for a, b in windows]


def chunks(max_words: int = MAX_WORDS, overlap: int = OVERLAP_WORDS, max_chunks: int | None = MAX_CHUNKS):
    """An Arrow function ``text -> array<string>`` of passages, each under its document's header.

    What comes before the description is the header. Texts without one, or with a short description, stay whole.
    Sentence packing is sequential within a document; documents are independent rows.
    """
    for name, good in (("max_words", max_words >= 1), ("max_chunks", max_chunks is None or max_chunks >= 1), ("overlap", 0 <= overlap < max_words)):
        if not good:
            raise ValueError(f"{name} is out of range")

    def under_header(text: str) -> list[str]:
        body = text.find(DESCRIPTION)
        start = body + len(DESCRIPTION)
        windows = pack_sentences(text[start:], max_words, overlap) if body >= 0 else []
        if len(windows) < 2:
            return [text]
        return [text[:start] + window for window in windows[:max_chunks]]

    @pandas_udf(S.ArrayType(S.StringType()))
    def split_arrow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(under_header, na_action="ignore")

    return split_arrow


def passages(docs: DataFrame, chunker=None) -> DataFrame:
    """``(doc_id, chunk_no, passage)``."""
    chunker = chunker or chunks()
    return docs.select("doc_id", F.posexplode(chunker("text")).alias("chunk_no", "passage"))


def stored_hashes(index: DataFrame) -> DataFrame:
    """``(job_id, document_hash)`` of a written index; the vectors stay on disk."""
    return index.select("job_id", "document_hash")


def index_plan(docs: DataFrame, index: DataFrame, full: bool = False) -> DataFrame:
    """``(job_id, document_hash, status)``: new, changed, unchanged or stale, by content hash."""
    stored = index.select("job_id", F.col("document_hash").alias("_old"))
    joined = docs.select("job_id", F.col("document_hash").alias("_new")).join(stored, "job_id", "full_outer")
    status = (
        F.when(F.col("_new").isNull(), "stale")
        .when(F.col("_old").isNull(), "new")
        .when(F.lit(full) | (F.col("_old") != F.col("_new")), "changed")
        .otherwise("unchanged")
    )
    return joined.select("job_id", F.coalesce("_new", "_old").alias("document_hash"), status.alias("status"))


def index_counts(plan: DataFrame) -> DataFrame:
    status = F.col("status")
    return plan.agg(
        F.count_if(status.isin("new", "changed")).alias("indexed"),
        F.count_if(status == "stale").alias("deleted"),
        F.count_if(status == "unchanged").alias("skipped"),
    )


def update_index(docs: DataFrame, index: DataFrame, embed, full: bool = False) -> DataFrame:
    """The index after embedding only new and changed documents and dropping stale ones.

    ``embed`` maps a DataFrame with ``text`` to the same rows plus ``embedding``. Write the result to
    a new folder, then switch readers: it reads the old one. A rerun after a failure embeds only what
    is still missing, because the plan is derived from the stored hashes.
    """
    plan = index_plan(docs, index, full)
    todo = docs.join(plan.where("status in ('new', 'changed')").select("job_id"), "job_id", "left_semi")
    fresh = embed(todo).select(*index.columns)
    kept = index.join(plan.where("status = 'unchanged'").select("job_id"), "job_id", "left_semi").select(*index.columns)
    return kept.unionByName(fresh)


def refresh_payloads(docs: DataFrame, index: DataFrame) -> DataFrame:
    """New payload and hash for documents already indexed; vectors stay, others are left alone."""
    payload = [c for c in docs.columns if c in index.columns and c not in ("job_id", "embedding")]
    renamed = docs.select("job_id", F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in payload])
    joined = index.join(renamed, "job_id", "left")
    return joined.select(
        *[F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c) for c in index.columns]
    )


def upsert(table: DataFrame, rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows replace stored rows with the same key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))

"""Files in and out: postings, taxonomy files, judgment caches, results and versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from hiregrain.functions import text as T
from hiregrain.operators.ingest import FIELD_ALIASES, RECORD_FIELDS, ordered_map
from hiregrain.sources.json_list import read_json_list


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Raw postings with ``record_no`` from ``.csv`` (header required) or ``.json`` files.

    Every field is text. JSON is a list of objects or ``{"jobs": [...]}``, cut into byte ranges however large a file is.
    ``record_no`` is the 1-based position; over several files it goes on counting for JSON, and is unique and increasing for CSV.
    """
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return _read_csv(spark, path).withColumn("record_no", F.monotonically_increasing_id() + 1)
    if lowered.endswith(".json"):
        return _read_json(spark, path)
    raise ValueError("a postings file ends in .csv or .json")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    if not rows.columns:
        raise ValueError("the first row of a CSV file names its columns")
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("﻿"))


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings of JSON files, each read in parallel from its byte ranges; ``record_no`` counts over all of them."""
    return json_fields(read_json_list(spark, path, "jobs"))


def json_fields(records: DataFrame) -> DataFrame:
    """``record_no``, the fields and the ``extra`` ones of records given as JSON texts in ``value``."""
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    checked = F.coalesce(parsed, F.raise_error(F.lit("a posting is a JSON object")).cast("map<string,string>"))
    named = F.transform(F.map_entries("r"), lambda e: F.struct(_field(e["key"]).alias("key"), e["value"].alias("value")))
    entries = F.filter(named, lambda e: e["key"].isNotNull())
    # Of two spellings the later counts.
    parts = records.select("record_no", checked.alias("r")).select("record_no", ordered_map(entries).alias("_m"))
    extra = F.map_filter("_m", lambda k, v: ~k.isin(RECORD_FIELDS))
    # As the number is made here, filters on what is later made of the fields by Python functions stay above it and out of the scan.
    number = F.greatest("record_no", -F.monotonically_increasing_id())
    return parts.select(number.alias("record_no"), *[F.col("_m").getItem(f).alias(f) for f in RECORD_FIELDS], extra.alias("extra"))


def _field(key: Column) -> Column:
    """The field a JSON key stands for; null for a key that is itself a missing marker."""
    cleaned = T.collapse(key)
    folded = T.casefold(cleaned)
    target = cleaned
    for alias, field in FIELD_ALIASES.items():
        target = F.when(folded == alias, F.lit(field)).otherwise(target)
    return F.when(~folded.isin(T.MISSING), target)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """``(canonical, category, aliases)`` from ``{canonical: {category, aliases}}``."""
    parsed = F.from_json("value", "map<string,struct<category:string,aliases:array<string>>>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("canonical", "d")).select("canonical", "d.category", "d.aliases")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(left, right)`` names from a JSON list of two-element lists; another length is an error."""
    pair = F.col("p")
    checked = F.when(F.size(pair) == 2, pair).otherwise(F.raise_error(F.lit("every blocked pair needs two names")).cast("array<string>"))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return rows.select(checked.alias("p")).select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))


JUDGMENT = "grade:int,reason:string,doc_sha:string,prompt_version:string,model:string"


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Flat judgments from ``{query: {job id: {...}}}``: one object over a whole file, or one object a line.

    Whole files are tried first, so a pretty-printed cache is read too; a file that is neither form is an error.
    """
    kind = f"map<string,map<string,struct<{JUDGMENT}>>>"
    files = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    # from_json stops after the first object, so a file of lines is told by a line that starts after another has ended.
    by_line = F.col("value").rlike(r"(?s)\}\s*\n\s*\{\s*\"")
    parts = F.when(by_line, F.split("value", r"\R")).otherwise(F.array("value"))
    lines = files.select(F.explode(parts).alias("value")).where(F.trim("value") != "")
    parsed = F.coalesce(F.from_json("value", kind), F.raise_error(F.lit("a judgment cache holds objects of the form {query: {job id: judgment}}")).cast(kind))
    return (
        lines.select(F.explode(parsed).alias("query", "_jobs"))
        .select("query", F.explode("_jobs").alias("_id", "_j"))
        .select("query", F.col("_id").cast("bigint").alias("job_id"), "_j.*")
    )


def judgments_json(judgments: DataFrame) -> DataFrame:
    """One object ``{query: {job id: {...}}}`` per query and line; written as text by ``write_text``."""
    entry = F.struct("grade", "reason", "doc_sha", "prompt_version", "model")
    members = F.array_sort(F.collect_list(F.struct(F.col("job_id").cast("string").alias("k"), entry.alias("v"))))
    per_query = judgments.groupBy("query").agg(F.map_from_entries(members).alias("m"))
    return per_query.select(F.to_json(F.create_map("query", "m")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Metric or import report as JSON; timestamps become ISO text and decimals become doubles."""
    def plain(field: S.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, S.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, S.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        return c.alias(field.name)

    report.select(*[plain(f) for f in report.schema]).write.mode("overwrite").json(path)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a table version next to the older ones; a table is never overwritten while it is read."""
    target = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")


def undecided_proposals(saved: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals of a dry run whose names are still undecided when they are applied."""
    return saved.join(decisions.select(F.col("match_key").alias("key")), "key", "left_anti")

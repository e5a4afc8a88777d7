"""Queries over the driver's tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables, and the same data in the roles of a job market."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    @property
    def skills(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("category"),
            F.when(F.col("p_size") <= 10, "curated").otherwise("extracted").alias("origin"),
        )

    @property
    def job_skills(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "N", "preferred").otherwise("inferred")
        row, part, supplier = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        number = F.try_add(F.try_multiply(F.try_add(F.try_multiply(row, F.lit(1_000_000)), part), F.lit(100_000)), supplier)
        # Orders from some eleven million on don't fit: below zero, in the same order of rows, one that does.
        shorter = F.lit(-(1 << 63)) + row * (1 << 20) + F.pmod(F.xxhash64(part, supplier), F.lit(1 << 20))
        number = F.coalesce(number, F.when(part.isNotNull() & supplier.isNotNull(), shorter))
        return self.lineitem.select(
            number.alias("id"), F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"),
            kind.alias("requirement_type"), F.col("l_linestatus").alias("evidence_text"),
        )

    @property
    def companies(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    @property
    def jobs(self) -> DataFrame:
        """Postings: an order, located where its customer is; every fifth customer number is dropped."""
        located = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
        return self.orders.join(located, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws(" ", "c_mktsegment", F.lit("engineer"), "o_orderstatus").alias("title"),
            F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("company_id"),
            F.col("n_name").alias("location"), F.col("o_orderpriority").alias("employment_type"),
            F.concat_ws(" ", F.lit("Order of"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("by"), F.col("o_custkey").cast("string")).alias("description"),
            (F.col("o_orderkey") % 7).cast("int").alias("experience_years_min"),
            F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string")).alias("source_url"),
            F.col("o_orderdate").alias("posted_at"),
        )


# The same roles for the SQL side.
SKILLS = """skills AS (SELECT p_partkey AS id, p_name AS canonical_name, p_type AS category,
  CASE WHEN p_size <= 10 THEN 'curated' ELSE 'extracted' END AS origin FROM part)"""
JOB_SKILLS = """job_skills AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS id,
  l_orderkey AS job_id, l_partkey AS skill_id,
  CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'N' THEN 'preferred' ELSE 'inferred' END AS requirement_type,
  l_linestatus AS evidence_text FROM lineitem)"""
COMPANIES = "companies AS (SELECT c_custkey AS id, c_name AS name FROM customer)"
JOBS = """jobs AS (SELECT o_orderkey AS id, concat_ws(' ', c_mktsegment, 'engineer', o_orderstatus) AS title,
  CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS company_id, n_name AS location, o_orderpriority AS employment_type,
  concat_ws(' ', 'Order of', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'by', CAST(o_custkey AS VARCHAR)) AS description,
  CAST(o_orderkey % 7 AS INTEGER) AS experience_years_min, 'https://jobs.example.com/' || o_orderkey AS source_url,
  o_orderdate AS posted_at
  FROM orders LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON o_custkey = c_custkey)"""

WORD = r"\p{L}\p{N}_"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def key(x: str) -> str:
    return rf"regexp_replace({fold(collapse(x))}, '[\s.\-_/]', '', 'g')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[{WORD}+#]+(?:\.[{WORD}+#]+)*')"


def words(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[{WORD}]+')"


def mentioned(text: str, phrase: str) -> str:
    """Whole-word mention; ``text`` and ``phrase`` are folded and collapsed already."""
    return rf"(contains({text}, {phrase}) AND regexp_matches({text}, '(^|[^{WORD}])' || regexp_escape({phrase}) || '($|[^{WORD}])'))"


def named(text: str, text_words: str, phrase: str) -> str:
    """The same test, with a word list for phrases that are one plain word."""
    return f"CASE WHEN regexp_full_match({phrase}, '[{WORD}]+') THEN list_contains({text_words}, {phrase}) ELSE {mentioned(text, phrase)} END"


def check(sql: str | None = None):
    """Register a query under its function's name, with its SQL when one exists."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register

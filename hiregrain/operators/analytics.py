"""Read-only views for analysts' SQL, optionally scoped to a set of postings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns each view exposes.
VIEWS = {
    "jobs": ["id", "title", "company_id", "location", "employment_type", "experience_years_min", "posted_at", "ingested_at"],
    "companies": ["id", "name"],
    "skills": ["id", "canonical_name", "category"],
    "job_skills": ["id", "job_id", "skill_id", "requirement_type", "evidence_text"],
}
GRAM = 3  # letters of a pattern that must appear before it is tried


def curated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four relations reduced to the columns analysts may read."""
    return {name: tables[name].select(*[c for c in columns if c in tables[name].columns]) for name, columns in VIEWS.items() if name in tables}


def scope_to_jobs(tables: dict[str, DataFrame], job_ids: DataFrame) -> dict[str, DataFrame]:
    """The relations as if only the given postings (``job_id``) existed."""
    ids = job_ids.select("job_id").distinct()
    jobs = tables["jobs"].join(ids.withColumnRenamed("job_id", "id"), "id", "left_semi")
    links = tables["job_skills"].join(ids, "job_id", "left_semi")
    used_companies = jobs.select(F.col("company_id").alias("id"))
    used_skills = links.select(F.col("skill_id").alias("id"))
    scoped = {
        "jobs": jobs,
        "job_skills": links,
        "companies": tables["companies"].join(used_companies, "id", "left_semi"),
        "skills": tables["skills"].join(used_skills, "id", "left_semi"),
    }
    return {name: df.select(*tables[name].columns) for name, df in scoped.items()}


class Capped(NamedTuple):
    """The first rows of a result in a stated order, and one row ``cut`` telling whether there were more."""

    rows: DataFrame
    cut: DataFrame


def capped(result: DataFrame, rows: int, order: Sequence[Column | str]) -> Capped:
    """Cut a result to its first ``rows`` by ``order``; without an order the choice would be arbitrary."""
    if rows < 1 or not order:
        raise ValueError("a cap needs a positive number of rows and an order")
    return Capped(result.orderBy(*order).limit(rows), result.limit(rows + 1).agg((F.count("*") > rows).alias("cut")))


def query_views(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run an analyst's SELECT over the views; the tables are passed as named parameters of the text.

    Refer to them as ``{jobs}``, ``{companies}``, ``{skills}`` and ``{job_skills}``. The result is whole; see :func:`capped`.
    """
    return spark.sql(sql, **curated(tables))


def page(rows: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must not be negative and limit must be between 1 and 100")
    return rows.orderBy("id").offset(offset).limit(limit)


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a key table; an empty key table gives no rows."""
    return rows.join(keys.select(key), key, "left_semi").select(*rows.columns)


def by_hashes(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(kind, hash, id)``: the posting with the smallest id for every asked ``kind`` (``raw_hash`` or ``content_hash``) and ``hash``.

    Both hashes of a posting are asked for in one pass, and only postings that some question names leave the join.
    """
    kinds = ("raw_hash", "content_hash")
    unknown = F.raise_error(F.lit("a posting is looked up by raw_hash or content_hash")).cast("string")
    asked = wanted.select(F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(unknown).alias("kind"), "hash").distinct()
    held = postings.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hash")) for k in kinds])))
    return held.join(asked, ["kind", "hash"]).groupBy("kind", "hash").agg(F.min("id").alias("id"))


def search_then_count(
    questions: DataFrame, hits: DataFrame, tables: dict[str, DataFrame], count: Callable[[dict[str, DataFrame], list[str]], DataFrame]
) -> DataFrame:
    """Counts for many questions at once, each over its own search results or over all postings.

    ``questions`` has ``query_id`` and ``sql_scope`` (``search_results`` or ``all``), ``hits`` is ``(query_id, job_id)``.
    ``count`` gets the relations and the columns to group by. It is called once with the relations of all scoped questions, whose
    postings and links carry ``query_id``, and once with the plain relations, whose counts every question about all postings
    shares. A question scoped to results that found nothing has no rows.
    """
    scoped = questions.where("sql_scope = 'search_results'").select("query_id").distinct()
    found = hits.join(scoped, "query_id", "left_semi").select("query_id", "job_id").distinct()
    own = dict(tables)
    own["jobs"] = tables["jobs"].join(found.withColumnRenamed("job_id", "id"), "id")
    own["job_skills"] = tables["job_skills"].join(found, "job_id")
    counted = count(own, ["query_id"])
    everything = count(tables, []).withColumn("_scope", F.lit("all"))
    whole = questions.select("query_id", F.col("sql_scope").alias("_scope")).distinct().join(everything, "_scope").drop("_scope")
    return counted.unionByName(whole.select(*counted.columns))


def company_named(companies: DataFrame, names: DataFrame) -> DataFrame:
    """Case-insensitive lookup: ``names`` has ``name``."""
    wanted = names.select(F.lower("name").alias("_n")).distinct()
    return companies.withColumn("_n", F.lower("name")).join(wanted, "_n", "left_semi").select(*companies.columns)


def jobs_with_company_and_skills(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Every posting with its company name (null without one) and its distinct skill names."""
    named = job_skills.select("job_id", "skill_id").distinct().join(skills.select(F.col("id").alias("skill_id"), "canonical_name"), "skill_id")
    lists = named.groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_set("canonical_name")).alias("skills"))
    return jobs.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left").join(lists, "id", "left")


def silver_labels(rules: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """``(query_id, job_id)`` judged relevant by pattern rules.

    ``rules`` has ``query_id``, ``field`` (``skill`` or ``title``), ``pattern`` (an ILIKE pattern) and
    ``wanted``. A posting is relevant when any wanted pattern matches and no unwanted one does. Rules
    are matched against distinct titles and skill names, so the text of a posting is never paired with
    every rule.
    """
    def matched(values: DataFrame, field: str) -> DataFrame:
        kept = rules.where(F.col("field") == field)
        return _like_join(values, kept)

    titles = matched(jobs.select(F.col("title").alias("value")).where("title is not null").distinct(), "title")
    names = matched(skills.select(F.col("canonical_name").alias("value")).distinct(), "skill")
    by_title = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("value")).join(titles, "value")
    by_skill = (
        job_skills.select("job_id", "skill_id")
        .distinct()
        .join(skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("value")), "skill_id")
        .join(names, "value")
    )
    hits = by_title.select("query_id", "job_id", "wanted").unionByName(by_skill.select("query_id", "job_id", "wanted"))
    return (
        hits.groupBy("query_id", "job_id")
        .agg(F.bool_or("wanted").alias("_yes"), F.bool_or(~F.col("wanted")).alias("_no"))
        .where("_yes and not _no")
        .select("query_id", "job_id")
    )


def _like_join(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``(value, query_id, wanted)`` for rules whose pattern matches a value.

    A value can only match a pattern whose first letters of the longest literal part it holds. So both sides meet in an
    equi-join on such a piece of at most ``GRAM`` letters, and only then is the pattern tried. Patterns without a literal
    match by length alone; they meet every value on the empty piece.
    """
    lowered = rules.select("query_id", F.lower("pattern").alias("_p"), "wanted").distinct()
    literal = F.split("_p", "[%_]")
    longest = F.aggregate(literal, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    rule = lowered.withColumn("_gram", F.substring(longest, 1, GRAM))
    text = F.col("_v")

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[pieces(n) for n in range(1, GRAM + 1)]))
    lowered_values = values.select("value", F.lower("value").alias("_v")).distinct()
    met = lowered_values.select("value", "_v", F.explode(grams).alias("_gram")).join(rule, "_gram")
    quoted = F.concat(F.lit("\\Q"), F.col("_p"), F.lit("\\E"))
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("%"), F.lit("\\E.*\\Q")), F.lit("_"), F.lit("\\E.\\Q")), F.lit("$"))
    return met.where(F.regexp_like("_v", regex)).select("value", "query_id", "wanted").distinct()


def copy_labels(labels: DataFrame, same_as: DataFrame) -> DataFrame:
    """Add the labels of paraphrases: ``same_as`` has ``query_id`` and the query it shares labels with."""
    copied = same_as.join(labels.withColumnRenamed("query_id", "same_relevance_as"), "same_relevance_as").select("query_id", "job_id")
    return labels.unionByName(copied)

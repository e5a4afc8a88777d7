"""Scoring many CVs against many postings.

CV claims are ``(cv_id, seq, name, evidence)``; pairs to score are ``(cv_id, job_id)``. Pairs always
come from a target list or from search, never from crossing both tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators.taxonomy import lookup, market_skills, resolve, wordings
from hiregrain.plans.skew import first_per_key, top_per_key

REQUIRED_WEIGHT, PREFERRED_WEIGHT = 0.8, 0.2
SEMANTIC_WEIGHT = 0.6
MATCH_CANDIDATES, MATCH_LIMIT = 50, 10
MAX_QUERY_CHARS = 2000  # fixed value; ``None`` keeps the whole query


def quoted_claims(claims: DataFrame, cvs: DataFrame) -> DataFrame:
    """Claims whose evidence really occurs in the CV's text."""
    texts = cvs.select("cv_id", T.spaced(F.coalesce(T.casefold(T.collapse("text")), F.lit(""))).alias("_text"))
    trimmed = claims.select("cv_id", "seq", "name", F.trim("evidence").alias("evidence"))
    quoted = F.contains("_text", T.spaced(T.casefold(T.collapse("evidence"))))
    return trimmed.join(texts, "cv_id").where(quoted).drop("_text")


def recognize_skills(
    claims: DataFrame, cvs: DataFrame, skills: DataFrame, aliases: DataFrame, job_skills: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Recognized ``(cv_id, skill_id, skill, evidence)`` and unrecognized ``(cv_id, name)`` claims.

    A skill counts when the market asks for it and the quote itself names it in any spelling.
    """
    quoted = quoted_claims(claims, cvs)
    market = market_skills(job_skills).withColumn("_market", F.lit(True))
    resolved = resolve(quoted, lookup(skills, aliases)).join(market, "skill_id", "left")
    named_itself = T.mentions("evidence", "name")
    on_market = resolved.where("_market")
    by_name = on_market.where(named_itself)
    by_wording = (
        on_market.where(~named_itself)
        .join(wordings(skills, aliases).withColumnRenamed("name", "_wording"), "skill_id")
        .where(T.mentions("evidence", "_wording"))
        .select(*on_market.columns)
    )
    first = first_per_key(
        by_name.unionByName(by_wording).select("cv_id", "skill_id", "seq", "evidence"), ["cv_id", "skill_id"], ["seq"]
    )
    recognized = first.join(skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("skill")), "skill_id")
    unknown = resolved.where(F.col("_market").isNull() & F.contains(T.casefold("evidence"), T.casefold("name")))
    return recognized.select("cv_id", "skill_id", "skill", "evidence", "seq"), unknown.select("cv_id", "name").distinct()


def requirements(job_skills: DataFrame) -> DataFrame:
    """``(job_id, skill_id, is_required)``: required beats preferred, inferred links do not count."""
    return (
        job_skills.where(F.col("requirement_type").isin("required", "preferred"))
        .groupBy("job_id", "skill_id")
        .agg(F.bool_or(F.col("requirement_type") == "required").alias("is_required"))
    )


def skill_gaps(pairs: DataFrame, job_skills: DataFrame, skills: DataFrame, cv_skills: DataFrame) -> DataFrame:
    """Coverage, fit and the matched and missing skill names of every ``(cv_id, job_id)`` pair.

    Fit is 0.8 required plus 0.2 preferred coverage over the groups the posting has; 0 without any.
    """
    needed = pairs.join(requirements(job_skills), "job_id", "left").join(
        cv_skills.select("cv_id", "skill_id").distinct().withColumn("_has", F.lit(True)), ["cv_id", "skill_id"], "left"
    )
    named = needed.join(skills.select(F.col("id").alias("skill_id"), "canonical_name"), "skill_id", "left")
    has, required = F.coalesce(F.col("_has"), F.lit(False)), F.col("is_required")
    name = F.col("canonical_name")

    def names(condition) -> F.Column:
        return F.array_sort(F.collect_list(F.when(condition, name)))

    counted = named.groupBy("cv_id", "job_id").agg(
        F.count_if(required).alias("_r"),
        F.count_if(required & has).alias("_rh"),
        F.count_if(~required).alias("_p"),
        F.count_if(~required & has).alias("_ph"),
        names(has & required.isNotNull()).alias("matched_skills"),
        names(required & ~has).alias("missing_required_skills"),
        names(~required & ~has).alias("missing_preferred_skills"),
    )
    covered = counted.withColumn("required_coverage", F.col("_rh") / F.nullif(F.col("_r"), F.lit(0))).withColumn(
        "preferred_coverage", F.col("_ph") / F.nullif(F.col("_p"), F.lit(0))
    )
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for share, value in ((REQUIRED_WEIGHT, "required_coverage"), (PREFERRED_WEIGHT, "preferred_coverage")):
        total = total + F.coalesce(F.lit(share) * F.col(value), F.lit(0.0))
        weight = weight + F.when(F.col(value).isNotNull(), share).otherwise(0.0)
    fit = F.when(weight > 0, F.round(total / weight, 4)).otherwise(0.0)
    return covered.withColumn("fit_score", fit).drop("_r", "_rh", "_p", "_ph")


def missing_skill_frequency(gaps: DataFrame) -> DataFrame:
    """``(cv_id, kind, skill, frequency)``: share of a CV's target postings that miss each skill."""
    targets = gaps.groupBy("cv_id").agg(F.count("*").alias("_jobs"))
    kinds = F.array(
        F.struct(F.lit("required").alias("kind"), F.col("missing_required_skills").alias("names")),
        F.struct(F.lit("preferred").alias("kind"), F.col("missing_preferred_skills").alias("names")),
    )
    missing = gaps.select("cv_id", F.explode(kinds).alias("_k")).select("cv_id", "_k.kind", F.explode("_k.names").alias("skill"))
    counted = missing.groupBy("cv_id", "kind", "skill").agg(F.count("*").alias("_n")).join(targets, "cv_id")
    return counted.select("cv_id", "kind", "skill", (F.col("_n") / F.col("_jobs")).alias("frequency"))


def unknown_targets(targets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Smallest unknown target posting per CV; any row is an error."""
    unknown = targets.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")
    return unknown.groupBy("cv_id").agg(F.min("job_id").alias("job_id"))


def require_targets(targets: DataFrame, jobs: DataFrame) -> None:
    if targets.isEmpty():
        raise ValueError("at least one target posting is required")
    lowest = unknown_targets(targets, jobs).agg(F.min("job_id").alias("j")).first().j
    if lowest is not None:
        raise ValueError(f"target posting not found: {lowest}")


def gap_report(targets: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, cv_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-posting gaps and missing-skill frequencies for checked target lists."""
    require_targets(targets, jobs)
    gaps = skill_gaps(targets.select("cv_id", "job_id").distinct(), job_skills, skills, cv_skills)
    return gaps, missing_skill_frequency(gaps)


def cv_query(cvs: DataFrame, recognized: DataFrame, max_chars: int | None = MAX_QUERY_CHARS) -> DataFrame:
    """``(cv_id, query)``: summary, skills, projects, experience and education, at most ``max_chars`` characters."""
    listed = recognized.groupBy("cv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "skill"))), lambda x: x["skill"]), ", ").alias("_skills")
    )
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.array(
        F.coalesce(F.col("summary"), F.lit("")),
        F.coalesce(F.col("_skills"), F.lit("")),
        *[F.coalesce(F.array_join(c, "\n"), F.lit("")) for c in ("projects", "experience", "education")],
    )
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    query = F.array_join(kept, "\n")
    return cvs.join(listed, "cv_id", "left").select("cv_id", (query if max_chars is None else F.substring(query, 1, max_chars)).alias("query"))


def rank_matches(
    candidates: DataFrame, gaps: DataFrame, limit: int = MATCH_LIMIT, semantic_weight: float = SEMANTIC_WEIGHT
) -> DataFrame:
    """Blend ``(cv_id, job_id, semantic_score)`` with fit; candidates without a gap row are dropped."""
    blended = candidates.join(gaps, ["cv_id", "job_id"]).withColumn(
        "final_score", F.round(semantic_weight * F.col("semantic_score") + (1 - semantic_weight) * F.col("fit_score"), 9)
    )
    return top_per_key(blended, ["cv_id"], [F.desc("final_score"), F.desc("semantic_score"), F.asc("job_id")], limit)


def match_cvs(
    cv_vectors: DataFrame, vectors: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, cv_skills: DataFrame,
    limit: int = MATCH_LIMIT, candidates: int = MATCH_CANDIDATES, semantic_weight: float = SEMANTIC_WEIGHT,
) -> DataFrame:
    """Best postings per CV: nearest candidates by vector, then the blend with the skill fit."""
    from hiregrain.operators.dense import dense_top_k

    near = dense_top_k(cv_vectors.withColumnRenamed("cv_id", "query_id"), vectors, candidates).select(
        F.col("query_id").alias("cv_id"), F.col("doc_id").alias("job_id"), F.col("score").alias("semantic_score")
    )
    near = near.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    gaps = skill_gaps(near.select("cv_id", "job_id"), job_skills, skills, cv_skills)
    return rank_matches(near, gaps, limit, semantic_weight)

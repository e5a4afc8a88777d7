"""Retrieval metrics, rater agreement and evaluation reports over whole run tables.

A run is ``(query_id, method, doc_id, rank)``; labels are ``(query_id, doc_id)``; judgments are
``(query_id, doc_id, grade)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.plans.skew import even_batches, median, nearest_rank, position_in_group, top_per_key
from hiregrain.session import materialize


def metrics_at_k(runs: DataFrame, labels: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """``(query_id, method, recall, precision, mrr)`` at ``k``.

    A query without relevant documents is an error when strict, otherwise its recall is null.
    Precision divides by ``k`` even when fewer documents were returned.
    """
    relevant = labels.select("query_id", "doc_id").distinct()
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("_relevant"))
    marked = runs.join(relevant.withColumn("_rel", F.lit(True)), ["query_id", "doc_id"], "left")
    return _at_k(marked, totals, k, strict)


def metrics_at_k_by_topic(runs: DataFrame, query_topics: DataFrame, doc_topics: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """Like :func:`metrics_at_k`, where a document is relevant to every query that it shares a topic with.

    ``query_topics`` is ``(query_id, topic)``, ``doc_topics`` is ``(doc_id, topic)``; several topics each are fine, a null one is none.
    Relevant pairs are never written out: documents are counted per set of topics, and only sets are paired.
    """
    asked = _topic_sets(query_topics, "query_id", "_asked")
    held = _topic_sets(doc_topics, "doc_id", "_held")
    sizes = held.groupBy("_held").agg(F.count("*").alias("_docs")).withColumn("topic", F.explode("_held"))
    met = asked.select("_asked").distinct().withColumn("topic", F.explode("_asked")).join(sizes, "topic")
    relevant = met.select("_asked", "_held", "_docs").distinct().groupBy("_asked").agg(F.sum("_docs").alias("_relevant"))
    totals = asked.join(relevant, "_asked").select("query_id", "_relevant")
    marked = runs.join(asked, "query_id", "left").join(held, "doc_id", "left").withColumn("_rel", F.arrays_overlap("_asked", "_held"))
    return _at_k(marked, totals, k, strict)


def _topic_sets(topics: DataFrame, key: str, name: str) -> DataFrame:
    return topics.where("topic is not null").groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias(name))


def _at_k(marked: DataFrame, totals: DataFrame, k: int, strict: bool) -> DataFrame:
    """Metrics of runs whose relevant rows are marked by ``_rel``, given the number of relevant documents per query."""
    hit = F.coalesce(F.col("_rel"), F.lit(False)) & (F.col("rank") <= k)
    counted = (
        marked.groupBy("query_id", "method")
        .agg(F.count_if(hit).alias("_hits"), F.min(F.when(hit, F.col("rank"))).alias("_first"))
        .join(totals, "query_id", "left")
    )
    recall = F.col("_hits") / F.col("_relevant")
    if strict:
        message = F.concat(F.lit("no relevant documents for query "), F.col("query_id").cast("string"))
        recall = F.when(F.col("_relevant").isNull(), F.raise_error(message).cast("double")).otherwise(recall)
    return counted.select(
        "query_id", "method", recall.alias("recall"), (F.col("_hits") / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
    )


def summarize_methods(per_query: DataFrame, metrics: Sequence[str], latency: str | None = None) -> DataFrame:
    """Mean of every metric per method, with mean and median latency."""
    means = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    if latency is None:
        return per_query.groupBy("method").agg(*means)
    per_query = materialize(per_query)  # read by the means and twice by the median
    averaged = per_query.groupBy("method").agg(*means, F.avg(latency).alias(f"mean_{latency}"))
    return averaged.join(median(per_query, ["method"], latency, f"median_{latency}"), "method")


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def judged_metrics(runs: DataFrame, judgments: DataFrame, k_precision: int = 5, k_ndcg: int = 10) -> DataFrame:
    """Strict and lenient precision and nDCG per query and method over the judged pool.

    The ideal ranking is the best of the query's whole pool; nDCG is 0 when that is 0.
    """
    pool = judgments.select("query_id", "doc_id", "grade")
    best = top_per_key(pool, ["query_id"], [F.desc("grade"), F.asc("doc_id")], k_ndcg)
    ideal = best.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("_ideal"))
    graded = runs.join(pool, ["query_id", "doc_id"])
    near, grade = F.col("rank") <= k_precision, F.col("grade")
    scored = graded.groupBy("query_id", "method").agg(
        (F.count_if(near & (grade >= 2)) / F.lit(k_precision)).alias("strict_precision"),
        (F.count_if(near & (grade >= 1)) / F.lit(k_precision)).alias("lenient_precision"),
        F.sum(F.when(F.col("rank") <= k_ndcg, _gain(grade, F.col("rank"))).otherwise(0.0)).alias("_dcg"),
    )
    ndcg = F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0)
    return scored.join(ideal, "query_id").select("query_id", "method", "strict_precision", "lenient_precision", ndcg.alias("ndcg"))


def judged_report(runs: DataFrame, judgments: DataFrame, depth: int = 10, sections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Means per method over fully judged queries, and the queries left out.

    A query with any unjudged document in its pool is excluded. ``sections`` (``query_id``, ``section``) reports the
    sections of the query set apart.
    """
    by = ["section"] if sections is not None else []
    pool = candidate_pool(runs, depth)
    judged = pool.join(judgments, ["query_id", "doc_id"], "left")
    whole = judged.groupBy("query_id").agg(F.bool_and(F.col("grade").isNotNull()).alias("_whole"))
    complete = whole.where("_whole").select("query_id")
    graded = judged.where("grade is not null").join(complete, "query_id", "left_semi")
    per_query = judged_metrics(runs.where(F.col("rank") <= depth).join(complete, "query_id", "left_semi"), graded)
    if sections is not None:
        per_query = per_query.join(sections, "query_id")
    report = per_query.groupBy(*by, "method").agg(
        *[F.round(F.avg(m), 3).alias(m) for m in ("strict_precision", "lenient_precision", "ndcg")],
        F.count("*").alias("judged_cases"),
    )
    return report, whole.where("not _whole").select("query_id")


def agreement(pairs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs, raw agreement and Cohen's kappa (3 decimals) of two raters.

    Both come from the table of label counts. Kappa is 1 when chance agreement is 1 and null without
    pairs; without ``by`` there is always exactly one row.
    """
    by = list(by)
    counts = pairs.groupBy(*by, F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.count("*").alias("_c"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("_a").alias("label"), F.col("_c").alias("x"), zero.alias("y"), F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(zero).alias("same")),
        F.struct(F.col("_b").alias("label"), zero.alias("x"), F.col("_c").alias("y"), zero.alias("same")),
    )
    margins = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.label")
        .agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"), F.sum("s.same").alias("same"))
    )
    totals = margins.groupBy(*by).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("pairs"), F.sum("same").alias("_same"),
        F.sum(F.col("x").cast("double") * F.col("y")).alias("_xy"),
    )
    n = F.nullif(F.col("pairs"), F.lit(0)).cast("double")
    observed, expected = F.col("_same") / n, F.col("_xy") / (n * n)
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))
    return totals.select(*by, "pairs", F.round(observed, 3).alias("raw_agreement"), F.round(kappa, 3).alias("cohen_kappa"))


def silver_agreement(judged: DataFrame, threshold: int, last_labelled: int | None = None) -> DataFrame:
    """Agreement of binarized grades with silver labels, with both kinds of disagreement.

    ``judged`` has ``doc_id``, ``grade`` and boolean ``relevant``; documents after ``last_labelled``
    have no silver label, so they are skipped and counted.
    """
    labelled = F.lit(True) if last_labelled is None else F.col("doc_id") <= last_labelled
    marked = judged.select((F.col("grade") >= threshold).alias("_j"), F.col("relevant").alias("_s"), labelled.alias("_in"))
    inside = marked.where("_in")
    extra = marked.agg(
        F.struct(
            F.count_if(F.col("_in") & F.col("_j") & ~F.col("_s")).alias("judge_relevant_silver_not"),
            F.count_if(F.col("_in") & ~F.col("_j") & F.col("_s")).alias("silver_relevant_judge_not"),
            F.count_if(~F.col("_in")).alias("unlabelled_pairs_skipped"),
        ).alias("e")
    )
    return agreement(inside, "_j", "_s").withColumn("_e", extra.scalar()).select("pairs", "raw_agreement", "cohen_kappa", "_e.*")


def sample_pairs(pairs: DataFrame, size: int, seed: int, columns: Sequence[str] = ("query_id", "doc_id")) -> DataFrame:
    """A reproducible sample of distinct pairs that does not depend on the input's order."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return pairs.select(*columns).distinct().withColumn("_h", F.sha2(text, 256)).orderBy("_h").limit(size).drop("_h")


def review_sheet(sampled: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Sampled pairs with query and document text and empty grade columns; judge grades stay hidden."""
    return (
        sampled.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        .join(docs.select("doc_id", F.col("text").alias("search_document")), "doc_id")
        .select("query_id", "doc_id", "query", "search_document", F.lit(None).cast("int").alias("human_grade"), F.lit("").alias("human_note"))
    )


def human_agreement(review: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judge-human agreement: exact, at least 1 and at least 2; a grade outside 0..2 is an error."""
    human = F.col("human_grade")
    checked = F.when(
        human.isin(0, 1, 2), human
    ).otherwise(F.raise_error(F.concat(F.lit("human_grade must be 0, 1 or 2, got "), human.cast("string"))).cast("int"))
    graded = review.where(human.isNotNull()).withColumn("human_grade", checked)
    joined = graded.join(judgments.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    both = joined.where("grade is not null")
    views = F.explode(
        F.array(
            F.struct(F.lit("exact_0_1_2").alias("scale"), F.col("grade").alias("j"), F.col("human_grade").alias("h")),
            *[
                F.struct(F.lit(f"binary_grade_ge_{t}").alias("scale"), (F.col("grade") >= t).cast("int").alias("j"), (F.col("human_grade") >= t).cast("int").alias("h"))
                for t in (1, 2)
            ],
        )
    )
    missing = joined.agg(F.count_if(F.col("grade").isNull()).alias("m"))
    scales = review.sparkSession.range(3).select(
        F.when(F.col("id") == 0, "exact_0_1_2").otherwise(F.concat(F.lit("binary_grade_ge_"), F.col("id").cast("string"))).alias("scale")
    )
    found = agreement(both.select(views.alias("v")).select("v.*"), "j", "h", by=["scale"])
    # Without any graded pair there are three rows with null agreement.
    return scales.join(found, "scale", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long"))).withColumn("missing_judgments", missing.scalar())


def candidate_pool(runs: DataFrame, depth: int = 10) -> DataFrame:
    return runs.where(F.col("rank") <= depth).select("query_id", "doc_id").distinct()


def pending_pairs(pool: DataFrame, cache: DataFrame, prompt_version: str, hashes: DataFrame | None = None) -> DataFrame:
    """Pool pairs without a judgment at this prompt version and, if given, of this document text."""
    current = cache.where(F.col("prompt_version") == prompt_version)
    keys = ["query_id", "doc_id"]
    if hashes is not None:
        pool = pool.join(hashes.select("doc_id", "doc_sha"), "doc_id")
        keys.append("doc_sha")
    return pool.join(current.select(*keys), keys, "left_anti")


def planned_batches(pending: DataFrame, batch_size: int) -> DataFrame:
    """Number of judge calls still to make."""
    per_query = pending.groupBy("query_id").agg(F.ceil(F.count("*") / batch_size).alias("n"))
    return per_query.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))


def judge_batches(pending: DataFrame, batch_size: int, block_width: int = 100_000) -> DataFrame:
    """Pending pairs with their even batch number within the query."""
    sizes = pending.groupBy("query_id").agg(F.count("*").alias("size"))
    placed = position_in_group(pending, ["query_id"], [F.asc("doc_id")], F.floor(F.col("doc_id") / block_width))
    return even_batches(placed.join(sizes, "query_id"), ["query_id"], "position", "size", batch_size)


def routing_report(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, success rate and latency of a call log ``(correct, succeeded, latency)``."""
    by = list(by)
    base = log.groupBy(*by).agg(
        F.count("*").alias("calls"), F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.avg(F.col("succeeded").cast("int")).alias("success_rate"), F.avg("latency").alias("mean_latency"),
    )
    mid = median(log, by, "latency", "median_latency")
    tail = nearest_rank(log, by, "latency", 0.95, "p95_latency")
    if by:
        return base.join(mid, by).join(tail, by)
    return base.withColumn("median_latency", mid.scalar()).withColumn("p95_latency", tail.scalar())


def tools_succeeded(route: str, has_sql: str, has_search: str, has_error: str) -> Column:
    """Whether every tool the expected route needs has delivered."""
    route_c = F.col(route)
    return (
        ~F.col(has_error)
        & (~route_c.isin("sql", "both") | F.col(has_sql))
        & (~route_c.isin("search", "both") | F.col(has_search))
    )


def grounded_rate(cases: DataFrame) -> DataFrame:
    """Share of checked cases that are grounded; null when none was checked."""
    return cases.agg(F.avg(F.col("grounded").cast("int")).alias("grounded_rate"))


def sql_answer_correct(row: str, accepted: str, accepted_text: str) -> Column:
    """Whether the first result row (an array of values as text) holds an accepted integer or text."""
    joined = T.casefold(F.array_join(row, ", ", "null"))
    by_text = F.contains(joined, T.casefold(accepted_text))
    integers = F.filter(row, lambda v: v.rlike(r"^-?\d+$"))
    by_value = F.exists(integers, lambda v: F.array_contains(F.col(accepted), v.cast("long")))
    return F.coalesce(F.when(F.col(accepted_text).isNotNull(), by_text).otherwise(by_value), F.lit(False))


def exact_match_rates(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Executable and exact rates over cases: ``expected (case_id, value)``, ``actual (case_id, value, failed)``."""
    joined = expected.select("case_id", F.col("value").alias("_e")).join(actual.select("case_id", F.col("value").alias("_v"), "failed"), "case_id", "left")
    ran = ~F.coalesce(F.col("failed"), F.lit(True))
    return joined.agg(
        F.avg(ran.cast("int")).alias("executable_rate"),
        F.avg((ran & F.col("_e").eqNullSafe(F.col("_v"))).cast("int")).alias("exact_rate"),
    )


def corpus_mismatches(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unexpected or repeated in a corpus that must hold exactly the expected ones."""
    found = stored.groupBy(key).agg(F.count("*").alias("_n"))
    wanted = expected.select(key).distinct().withColumn("_w", F.lit(True))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    on = found[key].eqNullSafe(wanted[key])
    joined = found.join(wanted, on, "full_outer").select(F.coalesce(found[key], wanted[key]).alias(key), "_n", "_w")
    return joined.withColumn("problem", problem).where("problem is not null").select(key, "problem")

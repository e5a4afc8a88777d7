"""Metrics over search runs, raters over ``labels`` and logs over ``events``."""

from pyspark.sql import functions as F

from hiregrain.checks.registry import check
from hiregrain.checks.retrieval import vectors_of
from hiregrain.operators import dense as D
from hiregrain.operators import metrics as E

# Every vector asks; vectors with the same label are relevant. The run keeps the ten best others.
RUN = """cosine AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))
    / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))), 9) AS s
  FROM embeddings q CROSS JOIN embeddings d),
runs AS MATERIALIZED (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS method, doc_id, ql = dl AS rel,
  CASE WHEN ql = dl THEN 2 WHEN abs(ql - dl) = 1 THEN 1 ELSE 0 END AS grade, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM cosine QUALIFY rank <= 10)"""


def runs_of(t):
    every = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    found = D.dense_top_k(every, vectors_of(t), 10)
    return found.select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("method"), "doc_id", "rank")


def topics_of(t, key: str):
    """A vector's label is its topic, as a query and as a document."""
    return t.embeddings.select(F.col("vec_id").alias(key), F.col("label").alias("topic"))


def graded_runs(t):
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    d = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl"))
    grade = F.when(F.col("ql") == F.col("dl"), 2).when(F.abs(F.col("ql") - F.col("dl")) == 1, 1).otherwise(0)
    return runs_of(t).join(q, "query_id").join(d, "doc_id").withColumn("grade", grade)


METRICS = """m AS (SELECT query_id, method, count(*) FILTER (rel AND rank <= 5) AS hits, min(rank) FILTER (rel AND rank <= 5) AS first FROM runs GROUP BY 1, 2),
metric AS (SELECT m.query_id, method, hits / (SELECT count(*) FROM embeddings e WHERE e.label = (SELECT label FROM embeddings f WHERE f.vec_id = m.query_id)) AS recall,
  hits / 5 AS precision, coalesce(1.0 / first, 0) AS mrr FROM m)"""


@check(f"WITH {RUN}, {METRICS} SELECT query_id, method, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr FROM metric")
def metric_at_k(t):
    found = E.metrics_at_k_by_topic(runs_of(t), topics_of(t, "query_id"), topics_of(t, "doc_id"), 5)
    return found.select("query_id", "method", *[F.round(m, 6).alias(m) for m in ("recall", "precision", "mrr")])


@check(f"""WITH {RUN}, {METRICS} SELECT method, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, round(avg(mrr), 6) AS mean_mrr,
  round(avg(query_id % 37), 6) AS mean_latency, round(median(query_id % 37), 6) AS median_latency FROM metric GROUP BY 1""")
def metric_summary(t):
    found = E.metrics_at_k_by_topic(runs_of(t), topics_of(t, "query_id"), topics_of(t, "doc_id"), 5).withColumn("latency", F.col("query_id") % 37)
    means = E.summarize_methods(found, ["recall", "precision", "mrr"], "latency")
    return means.select("method", *[F.round(c, 6).alias(c) for c in means.columns if c != "method"])


JUDGED = """g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS best FROM runs),
j AS (SELECT query_id, method, count(*) FILTER (rank <= 5 AND grade >= 2) / 5 AS strict_precision, count(*) FILTER (rank <= 5 AND grade >= 1) / 5 AS lenient_precision,
  CASE WHEN sum(grade) = 0 THEN 0 ELSE sum((pow(2, grade) - 1) / log2(rank + 1)) / sum((pow(2, grade) - 1) / log2(best + 1)) END AS ndcg FROM g GROUP BY 1, 2)"""


@check(f"WITH {RUN}, {JUDGED} SELECT query_id, method, round(strict_precision, 6) AS strict_precision, round(lenient_precision, 6) AS lenient_precision, round(ndcg, 6) AS ndcg FROM j")
def metric_judged(t):
    runs = graded_runs(t)
    found = E.judged_metrics(runs.select("query_id", "method", "doc_id", "rank"), runs.select("query_id", "doc_id", "grade"))
    return found.select("query_id", "method", *[F.round(m, 6).alias(m) for m in ("strict_precision", "lenient_precision", "ndcg")])


@check(f"""WITH {RUN}, {JUDGED}, whole AS (SELECT query_id FROM runs GROUP BY 1 HAVING NOT bool_or(doc_id % 17 = 0))
SELECT method, round(avg(strict_precision), 3) AS strict_precision, round(avg(lenient_precision), 3) AS lenient_precision, round(avg(ndcg), 3) AS ndcg, count(*) AS judged_cases
FROM j WHERE query_id IN (SELECT query_id FROM whole) GROUP BY 1""")
def judged_report(t):
    runs = graded_runs(t)
    judgments = runs.where("doc_id % 17 <> 0").select("query_id", "doc_id", "grade")
    return E.judged_report(runs.select("query_id", "method", "doc_id", "rank"), judgments)[0]


@check(f"""WITH {RUN}, {JUDGED}, whole AS (SELECT query_id FROM runs GROUP BY 1 HAVING NOT bool_or(doc_id % 17 = 0))
SELECT query_id % 3 AS section, method, round(avg(strict_precision), 3) AS strict_precision, round(avg(lenient_precision), 3) AS lenient_precision, round(avg(ndcg), 3) AS ndcg,
  count(*) AS judged_cases FROM j WHERE query_id IN (SELECT query_id FROM whole) GROUP BY 1, 2""")
def judged_report_by_section(t):
    runs = graded_runs(t)
    judgments = runs.where("doc_id % 17 <> 0").select("query_id", "doc_id", "grade")
    sections = runs.select("query_id", (F.col("query_id") % 3).alias("section")).distinct()
    return E.judged_report(runs.select("query_id", "method", "doc_id", "rank"), judgments, sections=sections)[0]


@check(f"WITH {RUN} SELECT query_id FROM runs GROUP BY 1 HAVING bool_or(doc_id % 17 = 0)")
def judged_incomplete(t):
    runs = graded_runs(t)
    judgments = runs.where("doc_id % 17 <> 0").select("query_id", "doc_id", "grade")
    return E.judged_report(runs.select("query_id", "method", "doc_id", "rank"), judgments)[1]


def kappa(a: str, b: str, source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    return f"""counts AS (SELECT {keep}count(*) AS n, avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0 END) AS observed, avg(CAST({a} AS DOUBLE)) AS p, avg(CAST({b} AS DOUBLE)) AS q FROM {source} {group}),
chance AS (SELECT *, p * q + (1 - p) * (1 - q) AS expected FROM counts)"""


KAPPA = "n AS pairs, round(observed, 3) AS raw_agreement, round(CASE WHEN expected = 1 THEN 1 ELSE (observed - expected) / (1 - expected) END, 3) AS cohen_kappa"


@check(f"WITH {kappa('quality', 'toxic', 'labels')} SELECT {KAPPA} FROM chance")
def rater_agreement(t):
    return E.agreement(t.labels, "quality", "toxic")


@check(f"WITH l AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)), {kappa('quality', 'toxic', 'l', 'lang')} SELECT lang, {KAPPA} FROM chance")
def rater_agreement_by_language(t):
    return E.agreement(t.labels.join(t.documents, "doc_id"), "quality", "toxic", by=["lang"])


@check(f"""WITH {RUN}, inside AS (SELECT (grade >= 1)::INT AS a, (doc_id % 3 = 0)::INT AS b FROM runs WHERE doc_id <= 400), {kappa('a', 'b', 'inside')}
SELECT {KAPPA}, (SELECT count(*) FROM inside WHERE a = 1 AND b = 0) AS judge_relevant_silver_not, (SELECT count(*) FROM inside WHERE a = 0 AND b = 1) AS silver_relevant_judge_not,
  (SELECT count(*) FROM runs WHERE doc_id > 400) AS unlabelled_pairs_skipped FROM chance""")
def silver_label_agreement(t):
    judged = graded_runs(t).select("doc_id", "grade", (F.col("doc_id") % 3 == 0).alias("relevant"))
    return E.silver_agreement(judged, 1, 400)


@check(f"WITH {RUN} SELECT query_id, doc_id FROM (SELECT DISTINCT query_id, doc_id FROM runs) ORDER BY sha256(concat_ws('|', CAST(query_id AS VARCHAR), CAST(doc_id AS VARCHAR), '7')) LIMIT 50")
def review_sample(t):
    return E.sample_pairs(runs_of(t), 50, 7)


@check("""WITH s AS (SELECT item_id AS query_id, item_id AS doc_id FROM benchmark ORDER BY sha256(concat_ws('|', CAST(item_id AS VARCHAR), CAST(item_id AS VARCHAR), '3')) LIMIT 20)
SELECT query_id, s.doc_id, b.text AS query, d.text AS search_document, CAST(NULL AS INTEGER) AS human_grade, '' AS human_note FROM s JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)""")
def review_sheet(t):
    pairs = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return E.review_sheet(E.sample_pairs(pairs, 20, 3), queries, t.documents)


@check(f"""WITH {RUN}, review AS (SELECT query_id, doc_id, grade, doc_id % 3 AS human FROM runs WHERE query_id % 5 <> 0), paired AS (SELECT * FROM review WHERE doc_id % 13 <> 0),
s AS (SELECT 'exact_0_1_2' AS scale, grade AS a, human AS b FROM paired UNION ALL SELECT 'binary_grade_ge_1', (grade >= 1)::INT, (human >= 1)::INT FROM paired UNION ALL SELECT 'binary_grade_ge_2', (grade >= 2)::INT, (human >= 2)::INT FROM paired),
n AS (SELECT scale, count(*) AS pairs, avg((a = b)::INT) AS observed FROM s GROUP BY 1),
ma AS (SELECT scale, a AS label, count(*) AS x FROM s GROUP BY 1, 2), mb AS (SELECT scale, b AS label, count(*) AS y FROM s GROUP BY 1, 2),
e AS (SELECT scale, sum(x * y) AS xy FROM ma JOIN mb USING (scale, label) GROUP BY 1)
SELECT scale, pairs, round(observed, 3) AS raw_agreement, round((observed - xy / (pairs * pairs)) / (1 - xy / (pairs * pairs)), 3) AS cohen_kappa, (SELECT count(*) FROM review WHERE doc_id % 13 = 0) AS missing_judgments
FROM n JOIN e USING (scale)""")
def human_agreement(t):
    runs = graded_runs(t)
    review = runs.select("query_id", "doc_id", F.when(F.col("query_id") % 5 != 0, (F.col("doc_id") % 3).cast("int")).alias("human_grade"))
    return E.human_agreement(review, runs.where("doc_id % 13 <> 0").select("query_id", "doc_id", "grade"))


@check("""WITH r AS (SELECT event_type, event_id % 5 <> 0 AS correct, event_type <> 'error' OR event_id % 2 = 0 AS succeeded, value AS latency,
  row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS calls, round(avg(correct::INT), 6) AS accuracy, round(avg(succeeded::INT), 6) AS success_rate, round(avg(latency), 6) AS mean_latency,
  round(median(latency), 6) AS median_latency, round(min(latency) FILTER (i = round_even((n - 1) * 0.95, 0)), 6) AS p95_latency FROM r GROUP BY 1""")
def routing_report(t):
    log = t.events.select(
        "event_type", (F.col("event_id") % 5 != 0).alias("correct"), ((F.col("event_type") != "error") | (F.col("event_id") % 2 == 0)).alias("succeeded"), F.col("value").alias("latency")
    )
    report = E.routing_report(log, ["event_type"])
    return report.select("event_type", "calls", *[F.round(c, 6).alias(c) for c in report.columns if c not in ("event_type", "calls")])


CASES = """cases AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'search' ELSE 'both' END AS route, event_id % 4 <> 0 AS has_sql, event_id % 5 <> 0 AS has_search, event_type = 'error' AS failed FROM events)"""


@check(f"WITH {CASES} SELECT event_id, NOT failed AND (route = 'search' OR has_sql) AND (route = 'sql' OR has_search) AS ok FROM cases")
def tools_succeeded(t):
    cases = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "sql").when(F.col("event_id") % 3 == 1, "search").otherwise("both").alias("route"),
        (F.col("event_id") % 4 != 0).alias("has_sql"), (F.col("event_id") % 5 != 0).alias("has_search"), (F.col("event_type") == "error").alias("failed"),
    )
    return cases.select("event_id", E.tools_succeeded("route", "has_sql", "has_search", "failed").alias("ok"))


@check("SELECT round(avg((event_type <> 'error')::INT), 6) AS grounded_rate FROM events WHERE event_id % 3 = 0")
def grounded_rate(t):
    checked = F.when(F.col("event_id") % 3 == 0, F.col("event_type") != "error")
    return E.grounded_rate(t.events.select(checked.alias("grounded"))).select(F.round("grounded_rate", 6).alias("grounded_rate"))


@check("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN contains(lower(o_orderpriority), 'urgent') ELSE o_custkey % 10 IN (3, 5) OR o_orderkey IN (3, 5) END AS correct FROM orders""")
def sql_answer_correct(t):
    rows = t.orders.select(
        "o_orderkey", F.array((F.col("o_custkey") % 10).cast("string"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("row"),
        F.array(F.lit(3).cast("long"), F.lit(5).cast("long")).alias("accepted"), F.when(F.col("o_orderkey") % 2 == 0, "URGENT").alias("accepted_text"),
    )
    return rows.select("o_orderkey", E.sql_answer_correct("row", "accepted", "accepted_text").alias("correct"))


@check("""SELECT round(avg((o_orderkey % 7 <> 0)::INT), 6) AS executable_rate, round(avg((o_orderkey % 7 <> 0 AND o_custkey % 2 = o_orderkey % 2)::INT), 6) AS exact_rate FROM orders""")
def exact_match_rates(t):
    expected = t.orders.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 2).alias("value"))
    actual = t.orders.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 2).alias("value"), (F.col("o_orderkey") % 7 == 0).alias("failed"))
    return E.exact_match_rates(expected, actual).select(F.round("executable_rate", 6).alias("executable_rate"), F.round("exact_rate", 6).alias("exact_rate"))


@check("""WITH found AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), wanted AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(f.id, w.id) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM found f FULL JOIN wanted w ON f.id = w.id
WHERE n IS NULL OR w.id IS NULL OR n > 1""")
def corpus_mismatches(t):
    return E.corpus_mismatches(t.orders.select(F.col("o_custkey").alias("id")), t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), "id")

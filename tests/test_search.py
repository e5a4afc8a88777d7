import math
import random

import pytest
from pyspark.sql import functions as F

from hiregrain.operators import dense as D
from hiregrain.operators import documents as S
from hiregrain.operators import fusion as R
from hiregrain.operators import inference as N
from hiregrain.operators import keyword as K
from hiregrain.operators import matching as C
from hiregrain.operators import metrics as E


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id int, rank int")


def test_rank_fusion_counts_a_repeat_once(spark):
    fused = R.reciprocal_rank_fusion([ranking(spark, [(1, 7, 1), (1, 8, 2), (1, 7, 3)]), ranking(spark, [(1, 8, 1), (1, 9, 2)])]).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [8, 7, 9]
    assert fused[0].score == pytest.approx(1 / 62 + 1 / 61) and fused[1].score == pytest.approx(1 / 61)


def test_bm25_formula_and_empty_inputs(spark):
    docs = [(1, "docker docker python"), (2, "python sql"), (3, "java")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "Docker python"), (2, "!!")], "query_id long, text string")
    n, avg = 3, 2.0

    def part(df, tf, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))

    got = {(r.query_id, r.doc_id): r.score for r in K.bm25_top_k(q, d, 5).collect()}
    assert got.keys() == {(1, 1), (1, 2)}
    assert got[1, 1] == pytest.approx(part(1, 2, 3) + part(2, 1, 3)) and got[1, 2] == pytest.approx(part(2, 1, 2))
    assert K.bm25_top_k(q, d.limit(0), 5).isEmpty() and K.bm25_top_k(q.limit(0), d, 5).isEmpty()


def test_bm25_shuffles_scores_not_terms(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") for _ in range(60))) for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") for _ in range(5))) for i in range(20)], "query_id long, text string")
    plan = K.bm25_scores(queries, docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1  # the term table stays where it is
    hits = K.bm25_top_k(queries, docs, 3)
    assert "Aggregate" not in hits._jdf.queryExecution().executedPlan().toString() and hits.count() == 60  # ranked once, however often it is read


def test_bm25_sums_scores_where_the_terms_are(spark, monkeypatch):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") for _ in range(40))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") for _ in range(4))) for i in range(10)], "query_id long, text string")
    whole = {(r.query_id, r.doc_id): r.score for r in K.bm25_scores(queries, docs).collect()}
    monkeypatch.setattr(K, "SCORES", 100)
    scores = K.bm25_scores(queries, docs)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and ", 20), REPARTITION_BY_NUM" in exchanges[0]  # 2,000 scores in parts of 100, never shuffled
    assert {(r.query_id, r.doc_id): r.score for r in scores.collect()} == whole


def test_texts_are_not_shuffled_to_meet_the_hits(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(30)), 0, f"p{rnd.random()}") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, chunk_no int, passage string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(i, "abcdefgh"[i]) for i in range(8)], "query_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # more than the hits' size, less than the texts'
    try:
        hits = K.bm25_top_k(queries, docs, 3)
        pairs, reranked = R.passage_pairs(hits, docs), R.rerank_by_overlap(hits, queries, docs)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert "BroadcastHashJoin [doc_id" in (plan := reranked._jdf.queryExecution().executedPlan().toString()) and "LeftSemi, BuildRight" in plan
        for found in (pairs, reranked):
            assert {(r.query_id, r.doc_id) for r in found.collect()} == {(r.query_id, r.doc_id) for r in hits.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_both_dense_plans_agree_with_brute_force(spark):
    rnd = random.Random(1)
    vectors = [[rnd.uniform(-1, 1) for _ in range(6)] for _ in range(150)]
    vectors[10] = vectors[20] = vectors[30]
    table = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<float>")
    queries = table.withColumnRenamed("doc_id", "query_id").where("query_id < 40")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    expected = {q: [i for _, i in sorted((-round(cosine(vectors[q], v), 5), i) for i, v in enumerate(vectors))[:3]] for q in range(40)}
    got = {}
    for r in D.dense_top_k(queries, table, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == expected


def test_empty_index_is_an_error(spark):
    with pytest.raises(ValueError):
        D.require_index(spark.createDataFrame([], "doc_id long, embedding array<float>"))


def test_rerank_check(spark):
    a, b = ranking(spark, [(1, 7, 1), (1, 8, 2)]), ranking(spark, [(1, 7, 1), (1, 7, 2), (1, 9, 3)])
    assert {(r.doc_id, r.problem) for r in R.rerank_mismatches(a, b).collect()} == {(7, "duplicate"), (8, "missing"), (9, "extra")}
    with pytest.raises(ValueError):
        R.require_same_documents(a, b)


def test_index_update_is_incremental(spark):
    def docs(changed=()):
        return spark.createDataFrame([(i, f"text {i}{'!' if i in changed else ''}") for i in range(45)], "job_id long, text string").withColumn("document_hash", F.sha2("text", 256))

    def embed(df):
        return df.withColumn("embedding", F.array(F.length("text").cast("double")))

    empty = spark.createDataFrame([], "job_id long, document_hash string, embedding array<double>")
    counts = lambda d, i: tuple(S.index_counts(S.index_plan(d, i)).first())
    index = S.update_index(docs(), empty, embed)
    assert counts(docs(), empty) == (45, 0, 0) and counts(docs(), index) == (0, 0, 45)
    assert counts(docs([3]), index) == (1, 0, 44) and counts(docs().where("job_id <> 5"), index) == (0, 1, 44)
    assert S.update_index(docs([3]).where("job_id <> 5"), index, embed).count() == 44


def test_failed_batches_are_halved(spark):
    def make():
        def model(rows):
            import pandas as pd

            if (rows["x"] == 13).any():
                raise ValueError
            return pd.DataFrame({"y": rows["x"] * 2})

        return model

    df = spark.range(40).withColumnRenamed("id", "x")
    got = {r.x: r.y for r in N.infer(df, make, "y long", batch_size=8).collect()}
    assert got == {i: None if i == 13 else 2 * i for i in range(40)}


def test_batch_responses(spark):
    requests = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "batch int, item int")
    responses = spark.createDataFrame([(1, i, f"a{i}") for i in (1, 2, 2, 7, 0, None, 4)], "batch int, item int, answer string")
    assert {r.item: r.answer for r in N.reconcile(requests, responses).collect()} == {1: "a1", 2: None, 3: None, 4: "a4"}


@pytest.mark.parametrize(
    "required, preferred, own, fit",
    [([1, 2], [], [1, 2], 1.0), ([1, 2], [], [1], 0.5), ([3, 4, 1], [], [4], 0.3333), ([1], [], [9], 0.0), ([1, 2], [4], [1, 4], 0.6), ([], [], [1], 0.0)],
)
def test_fit(spark, required, preferred, own, fit):
    links = [(1, s, "required") for s in required] + [(1, s, "preferred") for s in preferred] + [(1, 8, "inferred")]
    gaps = C.skill_gaps(
        spark.createDataFrame([(5, 1)], "cv_id long, job_id long"), spark.createDataFrame(links, "job_id long, skill_id long, requirement_type string"),
        spark.createDataFrame([(i, f"s{i}") for i in range(10)], "id long, canonical_name string"), spark.createDataFrame([(5, s) for s in own], "cv_id long, skill_id long"),
    ).first()
    assert gaps.fit_score == fit
    assert gaps.missing_required_skills == sorted(f"s{i}" for i in set(required) - set(own))


def test_blend(spark):
    gaps = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "cv_id long, job_id long, fit_score double")
    near = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.5)], "cv_id long, job_id long, semantic_score double")
    got = C.rank_matches(near, gaps).orderBy("rank").collect()
    assert [(r.job_id, round(r.final_score, 9)) for r in got] == [(1, 0.64), (2, 0.3)]


def test_targets_are_checked(spark):
    jobs = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError, match="not found: 3"):
        C.require_targets(spark.createDataFrame([(1, 9), (1, 3), (1, 1)], "cv_id long, job_id long"), jobs)
    with pytest.raises(ValueError, match="at least one"):
        C.require_targets(spark.createDataFrame([], "cv_id long, job_id long"), jobs)


def test_kappa(spark):
    def kappa(pairs):
        row = E.agreement(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
        return row.pairs, row.cohen_kappa

    assert kappa([(1, 1), (1, 0), (0, 0), (0, 0)]) == (4, 0.5)
    assert kappa([(1, 0), (0, 1)]) == (2, -1.0)
    assert kappa([(1, 1), (1, 1)]) == (2, 1.0)
    assert kappa([]) == (0, None)


def test_ndcg_and_precision(spark):
    runs = spark.createDataFrame([(1, "m", i, i + 1) for i in range(3)], "query_id int, method string, doc_id int, rank int")
    grades = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1)], "query_id int, doc_id int, grade int")
    row = E.judged_metrics(runs, grades).first()
    assert row.ndcg == pytest.approx(3.5 / (3 + 1 / math.log2(3))) and row.strict_precision == 0.2


def test_recall_without_relevant_documents_is_an_error(spark):
    runs = spark.createDataFrame([(1, "m", 1, 1)], "query_id int, method string, doc_id int, rank int")
    labels = spark.createDataFrame([], "query_id int, doc_id int")
    with pytest.raises(Exception, match="no relevant documents"):
        E.metrics_at_k(runs, labels, 5).collect()


def test_topics_stand_for_the_pairs_they_would_make(spark):
    runs = spark.createDataFrame([(q, "a", d, r) for q in (1, 2, 3) for r, d in enumerate((10, 12, 11, None, 14), 1)], "query_id long, method string, doc_id long, rank int")
    asked = [(1, 0), (1, 0), (2, 0), (2, 1), (2, None), (3, 1), (None, 0)]
    held = [(10, 0), (10, 1), (10, 0), (11, 1), (12, 2), (13, 0), (None, 1), (14, None)]
    q, d = spark.createDataFrame(asked, "query_id long, topic int"), spark.createDataFrame(held, "doc_id long, topic int")
    by_pairs = sorted(E.metrics_at_k(runs, q.join(d, "topic"), 3).collect())
    assert sorted(E.metrics_at_k_by_topic(runs, q, d, 3).collect()) == by_pairs and len(by_pairs) == 3
    with pytest.raises(Exception, match="no relevant documents"):
        E.metrics_at_k_by_topic(runs, q.where("query_id <> 3"), d, 3).collect()
    # Documents of one topic are counted, not paired with the queries: a million pairs for each of 2,000 queries would be 2 * 10**9.
    many, every = spark.range(2_000).select(F.col("id").alias("query_id"), F.lit(0).alias("topic")), spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("topic"))
    run = many.select("query_id", F.lit("a").alias("method"), (F.col("query_id") * 7).alias("doc_id"), F.lit(1).alias("rank"))
    assert E.metrics_at_k_by_topic(run, many, every, 5).agg(F.min("recall"), F.max("recall")).first() == (1e-6, 1e-6)


def test_sample_does_not_depend_on_order(spark):
    pairs = spark.createDataFrame([(q, d) for q in range(10) for d in range(10)], "query_id int, doc_id int")
    a, b = E.sample_pairs(pairs, 7, 1), E.sample_pairs(pairs.orderBy(F.desc("doc_id")).union(pairs), 7, 1)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 7


def test_registered_passages_hold_whole_texts(spark, tmp_path):
    from hiregrain.checks import retrieval  # noqa: F401
    from hiregrain.checks.registry import QUERIES

    text = " ".join(f"w{i}." for i in range(2_000))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    passages = [r.passage for r in QUERIES["search_passages"](spark, str(tmp_path)).collect()]
    assert set(text.split()) <= {w for p in passages for w in p.split()}


def test_no_copy_of_a_block_is_shuffled(spark, monkeypatch):
    from hiregrain.plans import blocks

    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1.0, 0.5, 1.0]) + i % 3 for _ in range(4)]) for i in range(300)] + [(7, [1.0, 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    crossed = []
    monkeypatch.setattr(blocks, "written", lambda df: crossed.append(df) or df)
    whole = {tuple(r) for r in D.dense_top_k(queries, vectors, 5).collect()}
    one, two = (F.col("embedding").alias("value"), blocks.best_matches)
    parts = two(queries.select("query_id", one), vectors.select(F.col("doc_id").alias("item_id"), one), D.score_cosine, 5, 9, query_bytes=500, item_bytes=900)
    assert {tuple(r) for r in parts.collect()} == whole
    plan = crossed[1]._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "CartesianProduct" in final and final.count(" Exchange ") == 1 and "CoGroup" not in final  # that of the results, by query
    lengths = [math.sqrt(sum(x * x for x in v)) for _, v in rows]
    for at in (0, 41, 300):
        cosine = sorted((-round(sum(x * y for x, y in zip(rows[at][1], v)) / lengths[at] / n, 9), i) for (i, v), n in zip(rows, lengths))
        if rows[at][0] != 7:
            assert [(r[1], r[3]) for r in sorted(whole, key=lambda r: r[3]) if r[0] == rows[at][0]] == [(i, rank) for rank, (_, i) in enumerate(cosine[:5], 1)]

"""The stored keyword index against scores computed in Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hiregrain.operators import keyword as K
from hiregrain.operators import keyword_index as X


def texts(rng, n):
    subjects = [[f"{c}{i}" for i in range(30)] for c in "abcd"]
    common = ["the", "of", "and"]
    return [" ".join(rng.choice(subjects[d % 4] if rng.random() < 0.7 else common) for _ in range(rng.choice([0, 3, 12, 60]))) for d in range(n)]


def brute(queries, docs, k):
    split = {d: re.findall(r"\w+", t) for d, t in docs if t is not None}
    average, df = sum(map(len, split.values())) / len(split), Counter(w for t in split.values() for w in set(t))
    out = []
    for q, text in queries:
        scored = []
        for d, own in split.items():
            tf = Counter(own)
            parts = [n * math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / average)) for w, n in Counter(re.findall(r"\w+", text)).items() if tf[w]]
            if parts:
                scored.append((-round(sum(parts), 9), d))
        out += [(q, d, r) for r, (_, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "k"), [(4, 3), (64, 10), (4, 1000)])
def test_index_ranks_as_scores_do(spark, tmp_path, block, k):
    rng = random.Random(block)
    docs = list(enumerate(texts(rng, 300))) + [(900, None), (901, ""), (902, "a1 a1 a1"), (903, "a1 a1 a1")]
    queries = [(i, t) for i, t in enumerate(texts(rng, 25))] + [(100, "a1"), (101, "unheard of words"), (102, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = X.write_index(frame, str(tmp_path / "i"), block=block, buckets=4)
    want = brute(queries, docs, k)
    got = index.top_k(asked, k)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got.collect()) == want
    again = X.open_index(spark, str(tmp_path / "i"))
    few = frame.where("doc_id % 7 = 0")
    inside = [(r.query_id, r.doc_id, r["rank"]) for r in again.top_k(asked, k, within=few).collect()]
    plain = [(r.query_id, r.doc_id, r["rank"]) for r in K.bm25_top_k(asked, frame.where("text is not null"), k, within=few).collect()]
    assert sorted(inside) == sorted(plain)


def test_blocks_are_skipped_and_texts_not_read(spark, tmp_path):
    rng = random.Random(3)
    spoken = [f"{'abcd'[d % 4]}the " * 6 + t for d, t in enumerate(texts(rng, 2_000))]  # every subject has a word of its own that is frequent
    spoken += ["a7 " * 6] * 10  # nothing else comes near these for a7
    frame = spark.createDataFrame(list(enumerate(spoken)), "doc_id long, text string")
    index = X.write_index(frame, str(tmp_path / "i"), block=16)
    rare = spark.createDataFrame([(1, "a1 a2 a3 a4 a5"), (2, "b7 b8 b9"), (3, "a7")], "query_id long, text string")
    told = {r.query_id: (r.blocks, r.blocks_read) for r in index.skipped(rare, 5).collect()}
    every = index.postings().select("block").distinct().count()
    assert all(read <= blocks < every / 2 for blocks, read in told.values())  # other subjects have other blocks
    assert told[3][1] < told[3][0] / 2
    assert {f.name for f in index.postings().schema} == {"bucket", "token", "block", "impact", "entries"}


def test_an_index_that_was_not_finished_is_none(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    X.write_index(frame, str(tmp_path / "i"))
    assert X.open_index(spark, str(tmp_path / "i")) is not None
    assert X.open_index(spark, str(tmp_path / "nothing")) is None
    empty = X.write_index(frame.where("false"), str(tmp_path / "e"))
    assert empty.top_k(frame.withColumnRenamed("doc_id", "query_id"), 3).collect() == []


def test_counts_in_a_row(spark):
    row = spark.range(1).select(X.term_counts(F.array(*[F.lit(x) for x in ("b", "a", "b", "c", "b")])).alias("t"), X.term_counts(F.array().cast("array<string>")).alias("e")).first()
    assert [tuple(x) for x in row.t] == [("a", 1), ("b", 3), ("c", 1)] and row.e == []


def test_scores_are_summed_where_the_postings_are(spark, tmp_path):
    rng = random.Random(9)
    rows = list(enumerate(texts(rng, 200))) + [(3, "a1 a1 a2"), (3, "b1 the the the"), (5, "c9"), (5, "c9")]  # ids repeated, with other texts
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts(rng, 12))] + [(50, "a1 b1 c9 the")], "query_id long, text string")
    index = X.write_index(frame, str(tmp_path / "i"), block=8, buckets=4)
    blocks = index.postings().select("block", F.explode("entries").alias("e")).select("block", "e.doc_id").distinct().groupBy("doc_id").count()
    assert blocks.where("count > 1").isEmpty()
    weights, bounds, *_ = index.plan(asked, 5)
    scores = index.scores(bounds, weights, frame.where("doc_id < 150"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" not in plan and "Exchange hashpartitioning(doc_id" not in plan
    n, average, df = len(rows), sum(len(t.split()) for _, t in rows) / len(rows), Counter(w for _, t in rows for w in set(t.split()))
    want = Counter()
    for q, text in ((r.query_id, r.text) for r in asked.collect()):
        for d, own in rows:
            for w, tf in Counter(own.split()).items():
                if w in text.split() and d < 150:
                    want[q, d] += text.split().count(w) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own.split()) / average))
    got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in got)

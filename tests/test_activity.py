import math
import random

import pytest
from pyspark.sql import functions as F

from hiregrain.operators import conversation as C
from hiregrain.operators import groundedness as G
from hiregrain.operators import quota as Q
from hiregrain.plans import skew as K
from hiregrain.streaming.ingest import stream_import
from hiregrain.streaming.quota import stream_quota


def replay(calls, limit, window):
    """Call by call, looking back over all admitted calls of the client."""
    admitted, out = {}, {}
    for client, call, at in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        recent = [t for t in admitted.setdefault(client, []) if at - t < window * Q.MICROS]
        out[call] = None if len(recent) < limit else max(1, math.ceil((window * Q.MICROS - (at - recent[0])) / Q.MICROS))
        if out[call] is None:
            admitted[client].append(at)
    return out


def replay_capped(calls, limit, window, per_day):
    admitted, days, out = {}, {}, {}
    for client, call, at in sorted(calls, key=lambda c: (c[2], c[1])):
        day = at // Q.DAY
        if days.get(day, 0) >= per_day:
            out[call] = Q.DAILY_WAIT
            continue
        recent = [t for t in admitted.setdefault(client, []) if at - t < window * Q.MICROS]
        out[call] = None if len(recent) < limit else max(1, math.ceil((window * Q.MICROS - (at - recent[0])) / Q.MICROS))
        if out[call] is None:
            admitted[client].append(at)
            days[day] = days.get(day, 0) + 1
    return out


@pytest.mark.parametrize("limit", [1, 3])
def test_quota_of_a_busy_client_spans_partitions(spark, limit):
    rnd = random.Random(5)
    calls = [("hot" if rnd.random() < 0.6 else f"c{rnd.randrange(5)}", i, rnd.randrange(4000) * Q.MICROS) for i in range(1500)]
    got = Q.sliding_quota(spark.createDataFrame(calls, "client string, call_id long, at long"), limit, 60)
    assert {r.call_id: r.wait for r in got.collect()} == replay(calls, limit, 60)


def test_quota_by_hand(spark):
    """Two calls in thirty seconds: the third comes a second too early, the fourth in time; another client has its own window."""
    seconds = {1: ("k", 10), 2: ("k", 25), 3: ("k", 39), 4: ("k", 41), 5: ("m", 26)}
    calls = spark.createDataFrame([(c, i, t * Q.MICROS) for i, (c, t) in seconds.items()], "client string, call_id long, at long")
    assert {r.call_id: (r.admitted, r.wait) for r in Q.sliding_quota(calls, 2, 30).collect()} == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (True, None), 5: (True, None)}
    assert {r.call_id: r.wait for r in Q.capped_quota(calls, 2, 3, 30).collect()} == {1: None, 2: None, 5: None, 3: Q.DAILY_WAIT, 4: Q.DAILY_WAIT}


def test_calls_stopped_by_the_daily_cap_leave_no_trace(spark):
    midnight, s = Q.DAY, Q.MICROS
    calls = [("a", 1, midnight - 50 * s), ("a", 2, midnight - 30 * s), ("a", 3, midnight + 5 * s)]
    frame = spark.createDataFrame(calls, "client string, call_id long, at long")
    assert {r.call_id: r.wait for r in Q.capped_quota(frame, 2, 1).collect()} == {1: None, 2: Q.DAILY_WAIT, 3: None}
    rnd = random.Random(7)
    many = [(f"c{rnd.randrange(3)}", i, rnd.randrange(4 * 24) * 3600 * s + rnd.randrange(3000) * s) for i in range(400)]
    frame = spark.createDataFrame(many, "client string, call_id long, at long")
    assert {r.call_id: r.wait for r in Q.capped_quota(frame, 2, 40, 7200).collect()} == replay_capped(many, 2, 7200, 40)


def test_streaming_quota_equals_batch(spark, tmp_path):
    rnd = random.Random(6)
    calls = [(f"c{rnd.randrange(3)}", i, 1000 + rnd.randrange(600)) for i in range(200)] + [("flush", 999, 100_000)]
    rows = spark.createDataFrame(calls, "client string, call_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for part in range(2):
        rows.where(F.col("call_id") % 2 == part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = (
        stream_quota(stream, 2, 60).writeStream.format("memory").queryName("quota").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = {r.call_id: r.wait for r in spark.table("quota").collect() if r.call_id != 999}
    assert got == replay([(c, i, s * Q.MICROS) for c, i, s in calls if i != 999], 2, 60)


def test_streaming_quota_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(9)
    calls = [(f"c{rnd.randrange(2)}", i, 1000 + i * 3 + rnd.randrange(20)) for i in range(120)] + [("flush", 999, 100_000)]
    rows = spark.createDataFrame(calls, "client string, call_id long, s long").withColumn("ts", F.timestamp_seconds("s"))

    def run(name):
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = (
            stream_quota(stream, 3, 40).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "ck")).start()
        )
        query.processAllAvailable()
        query.stop()

    for part, chosen in enumerate((F.col("call_id") < 50, F.col("call_id").between(50, 90), F.col("call_id") > 90)):
        rows.where(chosen).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        run(part)
    got = [(r.call_id, r.wait) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.call_id != 999]
    assert len(got) == 120 and dict(got) == replay([(c, i, s * Q.MICROS) for c, i, s in calls if i != 999], 3, 40)


def test_streaming_import_stores_once(spark, tmp_path):
    schema = "record_no long, title string, description string, required_skills string"
    for part in range(2):
        rows = [(1 + part * 10, "T", "same text", "SQL"), (2 + part * 10, "T", f"text {part}", "SQL")]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stream_import(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    stored = spark.read.parquet(str(tmp_path / "out" / "postings"))
    assert sorted(r.description for r in stored.collect()) == ["same text", "text 0", "text 1"]


def test_order_statistics_of_a_large_group(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("k"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    values = {1: sorted(i * 7919 % 60_000 for i in range(0, 60_000, 3)), 2: sorted(i * 7919 % 60_000 for i in range(60_000) if i % 3)}
    got = {r.k: r.p for r in K.nearest_rank(rows, ["k"], "v", 0.95, "p").collect()}
    assert got == {k: v[min(round((len(v) - 1) * 0.95), len(v) - 1)] for k, v in values.items()}
    got = {r.k: r.m for r in K.median(rows, ["k"], "v", "m").collect()}
    assert got == {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in values.items()}


def test_halo_blocks_see_the_whole_window(spark):
    rnd = random.Random(2)
    calls = [("a" if rnd.random() < 0.8 else "b", i, rnd.randrange(2000) * Q.MICROS) for i in range(400)]
    df = spark.createDataFrame(calls, "client string, call_id long, at long")
    got = {r.call_id: r.recent for r in Q.offered_load(df, 60, block_seconds=60).collect()}
    assert got == {i: sum(c2 == c and t - 60 * Q.MICROS < t2 <= t for c2, _, t2 in calls) for c, i, t in calls}


def test_context_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"message {t}") for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("summary", F.col("text"))
    got = {r.turn: r["query"] for r in C.fold_context(df).collect()}
    assert set(got) == set(range(0, 40, 2)) and got[0] == "message 0"
    for turn in range(6, 40, 2):
        lines = [f"- {'Tôi' if t % 2 == 0 else 'Trợ lý'}: message {t}" for t in range(turn - 5, turn)]
        assert got[turn] == C.HEADER + "\n".join(lines) + "\n" + C.SUFFIX + f"message {turn}"


def grounded(spark, answer):
    answers = spark.createDataFrame([(1, "How many?", answer)], "answer_id long, question string, answer string")
    jobs = spark.createDataFrame(
        [(1, 17, "AI Engineer", "VinAI", 0.8734), (1, 31, "Computer Vision Engineer", "FPT", 0.5)], "answer_id long, job_id long, title string, company string, score double"
    )
    values = spark.createDataFrame([(1, "1081")], "answer_id long, value string")
    catalog = spark.createDataFrame([("title", "Data Scientist"), ("title", "AI Engineer"), ("company", "Google")], "kind string, name string")
    report, unsupported = G.check_answers(answers, jobs, values, catalog)
    return report.first(), {(r.kind, r.value) for r in unsupported.collect()}


def test_grounded_answer(spark):
    report, unsupported = grounded(spark, '1. There are 1,081 postings; job 17 AI Engineer scores 0.87. {"job_id": 31, "title": "Computer Vision Engineer", "company": "fpt"}')
    assert report.grounded and unsupported == set()
    assert (report.checked_job_id, report.checked_title, report.checked_company) == (2, 2, 1)


def test_fabricated_answer(spark):
    report, unsupported = grounded(spark, 'Job 999 Data Scientist at Google pays 5000; see {"job_id": 17, "title": "Chef", "company": "VinAI"} and 42')
    assert not report.grounded
    assert unsupported == {
        ("job_id", "999"), ("title", "Data Scientist"), ("company", "Google"), ("number", "5000"), ("number", "42"), ("number", "999"), ("job_attribute", "17.title=Chef"),
    }


def test_no_claims_is_grounded(spark):
    report, unsupported = grounded(spark, "nothing to say")
    assert report.grounded and report.checked_number == 0 and unsupported == set()


def test_an_unreadable_store_is_an_error(spark, tmp_path):
    from hiregrain.streaming.ingest import stored_keys

    assert stored_keys(spark, str(tmp_path / "nothing"), 3).count() == 0
    (tmp_path / "postings").mkdir()
    (tmp_path / "postings" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        stored_keys(spark, str(tmp_path / "postings"), 3).count()

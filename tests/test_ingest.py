import json
import random

import pytest
from pyspark.sql import functions as F

from hiregrain.operators import ingest as I
from hiregrain.plans.graphs import components, keep_first_on_both
from hiregrain.sources import files as S


def greedy(rows):
    a, b, kept = set(), set(), []
    for i, x, y in sorted(rows):
        if x in a or (y is not None and y in b):
            continue
        kept.append(i)
        a.add(x)
        if y is not None:
            b.add(y)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_two_key_pass_equals_the_sequential_one(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"h{min(rnd.randrange(40), rnd.randrange(40))}", None if rnd.random() < 0.2 else f"u{rnd.randrange(25)}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r.i for r in keep_first_on_both(df, "i", "a", "b").collect()) == greedy(rows)


@pytest.mark.parametrize("length", [24, 2000])
def test_two_key_chains_take_few_jobs(spark, length):
    rows = [(i, f"h{(i + 1) // 2}", f"u{i // 2}") for i in range(length)]  # every row shares a key with the one before
    made = keep_first_on_both(spark.createDataFrame(rows, "i int, a string, b string"), "i", "a", "b")
    assert sorted(r.i for r in made.collect()) == greedy(rows)


def test_components_with_a_hub(spark):
    rnd = random.Random(3)
    rows = [(i, "hub" if i % 3 == 0 else f"k{rnd.randrange(60)}") for i in range(120)] + [(i, f"k{rnd.randrange(60)}") for i in range(0, 120, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "node int, key string")).collect()}
    parent = {i: i for i in range(120)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for n, k in rows:
        parent[find(n)] = find(first.setdefault(k, n))
    lowest = {}
    for n in range(120):
        lowest[find(n)] = min(lowest.get(find(n), n), n)
    assert got == {n: lowest[find(n)] for n in range(120)}


def records(spark):
    rows = [
        (1, "AI Engineer", "Acme", "Build models with Python.", "Python; Docker", "https://e.com/1"),
        (2, "AI Engineer", "Acme", "Build models with Python.", "Python; Docker", "https://e.com/1"),
        (3, None, "Acme", "No title here.", "Python", None),
        (4, "Data Engineer", None, "Pipelines in SQL.", None, "https://e.com/4"),
        (5, "Tester", "Beta", None, "SQL", None),
        (6, "Other", "acme", "Different text.", "SQL", "not a url"),
    ]
    return spark.createDataFrame(rows, "record_no long, title string, company string, description string, required_skills string, source_url string")


def test_import_counts_and_reimport(spark):
    first = I.import_postings(records(spark))
    row = first.summary().first()
    assert (row.processed, row.inserted, row.skipped_duplicates, row.failed) == (6, 1, 1, 4)
    assert row.inserted + row.skipped_duplicates + row.failed == row.processed
    errors = {r.record: r.error for r in first.quarantine.collect()}
    assert set(errors) == {3, 4, 5, 6} and "source_url" in errors[6] and "description" in errors[5]
    again = I.import_postings(records(spark), first.postings).summary().first()
    assert (again.inserted, again.skipped_duplicates) == (0, 2)


def test_import_with_a_model(spark):
    def extract(pending):
        return pending.where("record_no = 4").select(
            "record_no", F.lit("Model").alias("title"), F.lit("X").alias("company"), "location", "employment_type", "source_url",
            F.lit(2).alias("experience_years_min"), F.array(F.lit("SQL")).alias("required_skills"), F.array().cast("array<string>").alias("preferred_skills"),
        )

    result = I.import_postings(records(spark), extract=extract)
    kept = {r.record_no: r for r in result.postings.collect()}
    assert set(kept) == {1, 4}
    assert kept[4].title == "Data Engineer" and kept[4].company is None and kept[4].required_skills == ["SQL"]


def test_supplied_hash_wins(spark):
    df = spark.createDataFrame([(1, "d", "a" * 64), (2, "d", "A" * 64)], "record_no long, description string, source_record_hash string")
    cleaned = I.clean_records(df)
    got = {r.record_no: r.h for r in cleaned.select("record_no", I.raw_hash(cleaned).alias("h")).collect()}
    assert got[1] == "a" * 64 and got[2] != "a" * 64 and len(got[2]) == 64


def test_field_aliases(spark):
    df = spark.createDataFrame([(1, "text", "Co", "3")], "record_no long, Job_Description string, company_name string, min_experience string")
    row = I.clean_records(df).first()
    assert (row.description, row.company, row.experience_years_min) == ("text", "Co", "3")


def test_read_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,description\nX,"line one\nline two"\nY,z\n', encoding="utf-8")
    rows = S.read_postings(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.record_no, r.title) for r in rows] == [(1, "X"), (2, "Y")] and rows[0].description == "line one\nline two"
    jobs = [{"title": "X", "job_description": "d", "required_skills": ["a", "b"], "salary": 5}, {"title": "Y", "description": "e"}]
    (tmp_path / "b.json").write_text(json.dumps({"jobs": jobs}))
    (tmp_path / "c.json").write_text(json.dumps(jobs))
    for name in ("b.json", "c.json"):
        rows = S.read_postings(spark, str(tmp_path / name)).collect()
        assert [(r.record_no, r.title, r.description) for r in rows] == [(1, "X", "d"), (2, "Y", "e")]
        assert rows[0].required_skills == '["a","b"]' and rows[0].extra == {"salary": "5"}
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="list of postings"):
        S.read_postings(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError):
        S.read_postings(spark, "x.txt")


def test_judgment_cache_round_trip(spark, tmp_path):
    cache = {"q": {"7": {"grade": 2, "reason": "r", "doc_sha": "s", "prompt_version": "v", "model": "m"}}}
    (tmp_path / "j.json").write_text(json.dumps(cache))
    flat = S.read_judgments(spark, str(tmp_path / "j.json"))
    assert [(r["query"], r.job_id, r.grade) for r in flat.collect()] == [("q", 7, 2)]
    assert json.loads(S.judgments_json(flat).first().value) == cache


def test_judgment_caches_keep_every_query(spark, tmp_path):
    entry = {"grade": 1, "reason": "r", "doc_sha": "s", "prompt_version": "v", "model": "m"}
    cache = {q: {str(j): entry for j in range(2)} for q in ("q1", "q2", "q3")}
    (tmp_path / "nested.json").write_text(json.dumps(cache, indent=1))
    flat = S.read_judgments(spark, str(tmp_path / "nested.json"))
    S.write_text(S.judgments_json(flat), str(tmp_path / "lines"))
    again = S.read_judgments(spark, str(tmp_path / "lines"))
    assert {(r["query"], r.job_id) for r in again.collect()} == {(q, j) for q in cache for j in range(2)}
    S.write_text(S.judgments_json(flat).coalesce(1), str(tmp_path / "one"))
    assert S.read_judgments(spark, str(tmp_path / "one")).count() == 6
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="judgment cache"):
        S.read_judgments(spark, str(tmp_path / "bad.json")).collect()


def test_json_fields_and_further_fields(spark, tmp_path):
    postings = [
        {"Job_Description": "old", "description": "new", "level": "2", "site": " x "}, {"description": "old", "JOB_DESCRIPTION": "new", "site": "x", "level": " 2 "},
        {"title": "t", "technical_skills": ["Ada", "n/a"], "description": "d", "none": "?"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(postings))
    raw = S.read_postings(spark, str(tmp_path / "p.json"))
    rows = raw.orderBy("record_no").collect()
    assert [r.description for r in rows] == ["new", "new", "d"] and rows[2].extra == {}
    cleaned = I.clean_records(raw)
    hashes = [r.h for r in cleaned.withColumn("h", I.raw_hash(cleaned)).orderBy("record_no").collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    done, _ = I.extract_structured(cleaned)
    assert [r.required_skills for r in done.collect()] == [["Ada"]]


def test_urls_are_compared_in_one_spelling(spark):
    urls = ["https://Example.com", "https://example.com/", "HTTPS://example.com:443/", "https://example.com/a", "https://example.com/A"]
    raw = spark.createDataFrame([(i, "t", f"d{i}", u, ["Ada"]) for i, u in enumerate(urls, 1)], "record_no long, title string, description string, source_url string, required_skills array<string>")
    assert sorted(r.record_no for r in I.import_postings(raw).postings.collect()) == [1, 4, 5]


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"PostgreSQL": {"category": "database", "aliases": ["postgres"]}}))
    (tmp_path / "b.json").write_text(json.dumps([["Java", "JavaScript"]]))
    row = S.read_definitions(spark, str(tmp_path / "a.json")).first()
    assert (row.canonical, row.category, row.aliases) == ("PostgreSQL", "database", ["postgres"])
    assert S.read_pairs(spark, str(tmp_path / "b.json")).first() == ("Java", "JavaScript")
    (tmp_path / "c.json").write_text(json.dumps([["a", "b", "c"]]))
    with pytest.raises(Exception, match="two names"):
        S.read_pairs(spark, str(tmp_path / "c.json")).collect()


def test_deduplication_reads_its_rows_once(spark):
    """Cleaning and hashing are the costly part; the passes over the keys must not repeat them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(number):
        made.add(1)
        return f"h{number % 9}"

    url = F.concat(F.lit("HTTP://Jobs.example/"), (F.col("id") % 7).cast("string"))
    rows = spark.range(1, 41).select(F.col("id").alias("record_no"), hashed("id").alias("raw_hash"), url.alias("source_url"))
    stored = spark.createDataFrame([("h3", "http://jobs.example/2")], "raw_hash string, source_url string")
    kept = sorted(r.record_no for r in I.drop_duplicates_on(rows, stored, "raw_hash").collect())
    fresh = [(i, f"h{i % 9}", f"u{i % 7}") for i in range(1, 41) if i % 9 != 3 and i % 7 != 2]
    assert kept == greedy(fresh)
    assert made.value == 40

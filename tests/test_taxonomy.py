import difflib

import pytest
from pyspark.sql import functions as F

from hiregrain.operators import learning as L
from hiregrain.operators import merges as M
from hiregrain.operators import taxonomy as X

SKILLS = "id long, canonical_name string, category string, origin string"
ALIASES = "skill_id long, alias string, source string, confidence decimal(3,2), reason string"
LINKS = "id long, job_id long, skill_id long, requirement_type string, evidence_text string"
DECISIONS = "match_key string, name string, decision string, skill_id long, confidence decimal(3,2), reason string, model string"
FILE = "canonical string, category string, aliases array<string>"


def state(spark, skills, aliases=(), links=(), decisions=()):
    return M.Taxonomy(
        spark.createDataFrame(list(skills), SKILLS), spark.createDataFrame(list(aliases), ALIASES), spark.createDataFrame(list(links), LINKS),
        spark.createDataFrame(list(decisions), DECISIONS),
    )


def none(spark):
    return spark.createDataFrame([], FILE)


def blocklist(spark, *pairs):
    return X.blocked_pairs(spark.createDataFrame(list(pairs), "a string, b string"), "a", "b")


def test_merge_links_keeps_evidence(spark):
    s = state(
        spark, [(1, "PostgreSQL", None, "curated"), (2, "Postgre SQL", None, "extracted")],
        links=[(10, 1, 1, "preferred", "PostgreSQL"), (11, 1, 2, "required", "Postgre SQL"), (12, 2, 2, "required", "pg"), (13, 3, 1, "inferred", "x"), (14, 3, 2, "required", "y")],
    )
    merged = M.apply_merges(s, M.plan_merges(s.skills, s.aliases, none(spark), s.job_skills))
    got = {r.id: (r.job_id, r.skill_id, r.requirement_type, r.evidence_text) for r in merged.job_skills.collect()}
    assert got == {11: (1, 1, "required", "Postgre SQL; PostgreSQL"), 12: (2, 1, "required", "pg"), 13: (3, 1, "inferred", "x"), 14: (3, 1, "required", "y")}
    assert [r.id for r in merged.skills.collect()] == [1]
    assert [(r.skill_id, r.alias, r.source) for r in merged.aliases.collect()] == [(1, "Postgre SQL", "merge")]


def test_blocked_pair_splits_a_component(spark):
    s = state(spark, [(1, "SQL", None, "curated"), (2, "MySQL", None, "curated"), (3, "sql.", None, "extracted")], aliases=[(2, "SQL", "curated", None, None)])
    plan = M.plan_merges(s.skills, s.aliases, none(spark), s.job_skills, blocklist(spark, ("SQL", "MySQL")))
    assert sorted((r.skill_id, r.keep_id) for r in plan.collect()) == [(1, 1), (3, 1)]
    with pytest.raises(ValueError):
        M.refuse_blocked(M.plan_merges(s.skills, s.aliases, none(spark), s.job_skills), s.aliases, blocklist(spark, ("SQL", "MySQL")))


def test_seed_is_idempotent(spark):
    definitions = spark.createDataFrame([("Docker", "platform", ["docker"]), ("PostgreSQL", "database", ["postgres", "postgre sql"])], FILE)
    s = state(spark, [(1, "docker", None, "extracted"), (2, "Kafka", None, "extracted")], links=[(1, 1, 1, "required", "docker")])
    once = M.seed_taxonomy(s, definitions)
    twice = M.seed_taxonomy(once, definitions)
    names = lambda t: sorted((r.canonical_name, r.origin) for r in t.skills.collect())
    assert names(once) == names(twice) == [("Docker", "curated"), ("Kafka", "extracted"), ("PostgreSQL", "curated")]
    spelled = lambda t: sorted(r.alias for r in t.aliases.collect())
    assert spelled(once) == spelled(twice) == ["docker", "postgre sql", "postgres"]


def test_normalization_rules(spark):
    skills = spark.createDataFrame([(1, "Python", None, "curated"), (2, "PostgreSQL", None, "curated")], SKILLS)
    aliases = spark.createDataFrame([(2, "postgres", "curated", None, None)], ALIASES)
    postings = spark.createDataFrame(
        [(1, ["Python", "Docker", "Kafka Streams"], ["python", "postgresql"], "Python and Postgres. Kafka Streams."), (2, ["kafka-streams"], [], "We use Kafka Streams")],
        "record_no long, required_skills array<string>, preferred_skills array<string>, evidence string",
    )
    got = X.normalize_skills(postings, skills, aliases)
    new = {r.canonical_name: r.id for r in got.new_skills.collect()}
    assert new == {"Kafka Streams": 3}
    assert sorted((r.job_id, r.skill_id, r.requirement_type, r.evidence_text) for r in got.links.collect()) == [
        (1, 1, "required", "Python"), (1, 2, "preferred", "postgresql"), (1, 3, "required", "Kafka Streams"), (2, 3, "required", "kafka-streams"),
    ]


def test_normalization_asks_a_text_only_for_skills_whose_first_claim_it_does_not_hold(spark):
    skills = spark.createDataFrame([(1, "Python", None, "curated"), (2, "C++", None, "curated"), (3, "node.js", None, "curated"), (4, "Go", None, "curated")], SKILLS)
    aliases = spark.createDataFrame([(1, "py", "curated", None, None), (2, "cpp", "curated", None, None), (3, "node js", "curated", None, None), (4, "golang", "curated", None, None)], ALIASES)
    postings = spark.createDataFrame(
        [
            (1, ["py", "Python"], ["cpp"], "Python; C++."),  # 1: the first claim is another spelling of what the text holds
            (2, ["node js", "go"], [], "Node.js and gopher"),
            (3, ["C++"], ["C++ ", None, ""], "c+ +"),
            (4, ["golang", "Rust  Lang"], ["rust lang"], "we say rust lang, go"),
            (4, ["golang"], ["py"], "python"),  # the same posting again with another text
            (None, ["py", "go"], ["python"], "python, go"),
            (5, None, ["go"], None),
        ],
        "record_no long, required_skills array<string>, preferred_skills array<string>, evidence string",
    )
    got = X.normalize_skills(postings, skills, aliases)
    assert [(r.id, r.canonical_name) for r in got.new_skills.collect()] == [(5, "Rust Lang")]
    assert sorted((r.job_id or 0, r.skill_id, r.requirement_type, r.evidence_text) for r in got.links.collect()) == [
        (0, 1, "preferred", "python"), (0, 4, "required", "go"),
        (1, 1, "required", "py"), (1, 2, "preferred", "cpp"),
        (2, 3, "required", "node js"),
        (4, 1, "preferred", "py"), (4, 4, "required", "golang"), (4, 5, "required", "Rust Lang"),
    ]


def test_normalization_shuffles_no_claim_to_meet_few_names(spark):
    skills = spark.createDataFrame([(1, "Python", None, "curated")], SKILLS)
    aliases = spark.createDataFrame([(1, "py", "curated", None, None)], ALIASES)
    postings = spark.createDataFrame([(i, ["py"], ["Python"], "python") for i in range(50)], "record_no long, required_skills array<string>, preferred_skills array<string>, evidence string")
    links = X.normalize_skills(postings, skills, aliases).links
    plan = links._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(name" in line or "Exchange hashpartitioning(key" in line]
    assert not exchanges and "Exchange hashpartitioning(job_id" in plan
    assert sorted((r.job_id, r.evidence_text) for r in links.collect()) == [(i, "py") for i in range(50)]


def test_nearest_equals_brute_force(spark):
    names = ["javascript", "postgre", "kubernets", "reactnative", "pyton"]
    known = ["JavaScript", "Java", "PostgreSQL", "MySQL", "Kubernetes", "React", "React Native", "Python", "PyTorch", "Go", "Docker", "SQL"]
    skills = spark.createDataFrame([(i, n, None, "curated") for i, n in enumerate(known)], SKILLS)
    keys = [n.lower().replace(" ", "") for n in known]
    expected = {}
    for name in names:
        scored = sorted((-difflib.SequenceMatcher(None, name, k).ratio(), i) for i, k in enumerate(keys) if k != name)[:3]
        expected[name] = [i for _, i in scored]
    queries = spark.createDataFrame([(n, n) for n in names], "key string, name string")
    got = {}
    for r in L.nearest_skills(queries, skills, 3).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.skill_id)
    assert got == expected


def test_decision_thresholds(spark):
    s = state(spark, [(1, "Excel", None, "curated"), (2, "Power BI", None, "curated")])
    answers = spark.createDataFrame(
        [("msexcel", "MS Excel", "same_as", 1, 0.95), ("xl", "XL", "same_as", 1, 0.8), ("newthing", "New Thing", "new", None, 0.7), ("shaky", "Shaky", "new", None, 0.6),
         ("excel", "Excel", "same_as", 1, 0.9), ("bi", "BI", "same_as", 2, 0.99)],
        "key string, name string, answer string, skill_id long, confidence double",
    ).withColumn("category", F.lit("c")).withColumn("reason", F.lit("r"))
    near = spark.createDataFrame([], "key string, skill_id long")
    got = L.decide(answers, s.skills, s.aliases, none(spark), blocklist(spark, ("BI", "Power BI")), near)
    assert {r.key: (r.decision, r.skill_id) for r in got.collect()} == {
        "msexcel": ("alias", 1), "xl": ("pending", 1), "newthing": ("new", None), "shaky": ("pending", None), "excel": ("new", None), "bi": ("pending", 2),
    }


def test_learn_then_revert(spark):
    s = state(
        spark, [(1, "Excel", None, "curated"), (2, "MS Excel", None, "extracted")],
        links=[(1, 1, 2, "required", "MS Excel"), (2, 2, 1, "required", "Excel"), (3, 3, 1, "required", "Excel"), (4, 3, 2, "required", "MS Excel")],
    )
    proposals = spark.createDataFrame([("msexcel", "MS Excel", "alias", 1, 0.95, None, "same")], "key string, name string, decision string, skill_id long, confidence double, category string, reason string")
    learned, refused = L.apply_decisions(s, proposals, none(spark), blocklist(spark, ("a", "b")))
    assert refused.isEmpty()
    assert [(r.alias, r.source) for r in learned.aliases.collect()] == [("MS Excel", "llm")]
    assert sorted((r.job_id, r.skill_id, r.evidence_text) for r in learned.job_skills.collect()) == [(1, 1, "MS Excel"), (2, 1, "Excel"), (3, 1, "Excel; MS Excel")]
    _, again = L.apply_decisions(learned, proposals, none(spark), blocklist(spark, ("a", "b")))
    assert again.count() == 1
    reverted, affected = L.revert_aliases(learned, spark.createDataFrame([("ms excel",)], "name string"))
    assert affected.first().affected == 2
    own = {r.canonical_name: r.id for r in reverted.skills.collect()}["MS Excel"]
    assert sorted((r.job_id, r.skill_id, r.evidence_text) for r in reverted.job_skills.collect()) == sorted(
        [(1, own, "MS Excel"), (2, 1, "Excel"), (3, 1, "excel"), (3, own, "MS Excel")]
    )
    assert reverted.decisions.first().decision == "rejected" and reverted.aliases.isEmpty()


def test_numbers_of_links_of_high_orders(spark, tmp_path):
    from hiregrain.checks.registry import Tables

    rows = [(1, 2, 3, 4), (54_000_000, 1, 7_200_000, 360_000), (54_000_000, 2, 1, 1), (216_000_000, 1, 1, 1), (9, 1, None, 1)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.selectExpr("*", "'R' as l_returnflag", "'O' as l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = {(r.job_id, r.skill_id): r.id for r in Tables(spark, str(tmp_path)).job_skills.collect()}
    assert ids[1, 3] == (10 * 1_000_000 + 3) * 100_000 + 4 and ids[9, None] is None  # as before, where it fits
    assert ids[54_000_000, 7_200_000] < ids[54_000_000, 1] < ids[216_000_000, 1] < 0

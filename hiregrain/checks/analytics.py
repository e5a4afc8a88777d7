"""The questions analysts ask, over orders as postings."""

from pyspark.sql import functions as F

from hiregrain.checks.registry import COMPANIES, JOB_SKILLS, JOBS, SKILLS, check
from hiregrain.checks.retrieval import BM25, DENSE, FUSED, docs_of, queries_of, query_vectors, ranked, vectors_of
from hiregrain.functions import text as T
from hiregrain.operators import analytics as A
from hiregrain.operators import fusion as R
from hiregrain.plans import skew as K

ALL = f"{JOBS}, {COMPANIES}, {SKILLS}, {JOB_SKILLS}"


def tables(t):
    return {"jobs": t.jobs, "companies": t.companies, "skills": t.skills, "job_skills": t.job_skills}


@check(f"""WITH {ALL}, l AS (SELECT job_id, string_agg(DISTINCT canonical_name, '|' ORDER BY canonical_name) AS s FROM job_skills JOIN skills s ON s.id = skill_id GROUP BY 1)
SELECT j.id, j.title, c.name AS company, s AS skills FROM jobs j LEFT JOIN companies c ON c.id = company_id LEFT JOIN l ON job_id = j.id""")
def jobs_full_scan(t):
    listed = A.jobs_with_company_and_skills(t.jobs, t.companies, t.job_skills, t.skills)
    return listed.select("id", "title", "company", F.array_join("skills", "|").alias("skills"))


@check(f"WITH {JOBS} SELECT id, title, location FROM jobs ORDER BY id LIMIT 20 OFFSET 40")
def jobs_page(t):
    return A.page(t.jobs, 40, 20).select("id", "title", "location")


@check(f"WITH {JOBS} SELECT id, title FROM jobs WHERE source_url = 'https://jobs.example.com/77' OR id = 5")
def jobs_point_lookup(t):
    return t.jobs.where((F.col("source_url") == "https://jobs.example.com/77") | (F.col("id") == 5)).select("id", "title")


@check("""WITH p AS (SELECT doc_id AS id, sha256(source || ':' || lang) AS raw_hash, sha256(text) AS content_hash FROM documents),
wanted AS (SELECT DISTINCT 'content_hash' AS kind, sha256(text) AS hash FROM documents WHERE n_chars % 3 = 0 UNION SELECT DISTINCT 'raw_hash', sha256(source || ':de') FROM documents UNION SELECT 'raw_hash', sha256('nobody'))
SELECT kind, hash, min(id) AS id FROM (SELECT 'raw_hash' AS kind, raw_hash AS hash, id FROM p UNION ALL SELECT 'content_hash', content_hash, id FROM p) JOIN wanted USING (kind, hash) GROUP BY 1, 2""")
def jobs_by_hash(t):
    """Documents as postings, looked up by the hash of their content or of their origin."""
    origin = lambda lang: T.sha_hex(F.concat("source", F.lit(":"), lang))
    postings = t.documents.select(F.col("doc_id").alias("id"), origin(F.col("lang")).alias("raw_hash"), T.sha_hex("text").alias("content_hash"))
    contents = t.documents.where("n_chars % 3 = 0").select(F.lit("content_hash").alias("kind"), T.sha_hex("text").alias("hash"))
    origins = t.documents.select(F.lit("raw_hash").alias("kind"), origin(F.lit("de")).alias("hash")).distinct()
    return A.by_hashes(postings, contents.unionByName(origins).unionByName(origins.select("kind", F.sha2(F.lit("nobody"), 256).alias("hash"))))


@check(f"WITH {JOBS} SELECT id, title FROM jobs WHERE id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49)")
def jobs_by_keys(t):
    return A.by_keys(t.jobs, t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id").select("id", "title")


@check(f"WITH {COMPANIES} SELECT id, name FROM companies WHERE lower(name) IN (SELECT lower('CUSTOMER#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) FROM supplier)")
def companies_by_name(t):
    names = t.supplier.select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    return A.company_named(t.companies, names)


def asked(t, sql: str):
    return A.query_views(t.spark, tables(t), sql)


@check(f"WITH {ALL} SELECT count(*) AS jobs FROM jobs")
def ask_total_jobs(t):
    return asked(t, "SELECT count(*) AS jobs FROM {jobs}")


@check(f"""WITH {ALL} SELECT s.canonical_name, count(DISTINCT j.id) AS jobs FROM jobs j JOIN job_skills js ON js.job_id = j.id JOIN skills s ON s.id = js.skill_id GROUP BY 1""")
def ask_jobs_per_skill(t):
    return asked(t, "SELECT s.canonical_name, count(DISTINCT j.id) AS jobs FROM {jobs} j JOIN {job_skills} js ON js.job_id = j.id JOIN {skills} s ON s.id = js.skill_id GROUP BY 1")


@check(f"""WITH {ALL} SELECT coalesce(c.name, 'none') AS company, count(*) AS jobs FROM jobs j LEFT JOIN companies c ON c.id = j.company_id GROUP BY 1""")
def ask_jobs_per_company(t):
    return asked(t, "SELECT coalesce(c.name, 'none') AS company, count(*) AS jobs FROM {jobs} j LEFT JOIN {companies} c ON c.id = j.company_id GROUP BY 1")


@check(f"""WITH {ALL}, all_rows AS (SELECT coalesce(c.name, 'none') AS company, count(*) AS jobs FROM jobs j LEFT JOIN companies c ON c.id = company_id GROUP BY 1)
SELECT company, jobs, (SELECT count(*) > 50 FROM all_rows) AS cut FROM all_rows ORDER BY jobs DESC, company LIMIT 50""")
def ask_capped_companies(t):
    """A report of the 50 companies with most postings, which says that there are more."""
    whole = asked(t, "SELECT coalesce(c.name, 'none') AS company, count(*) AS jobs FROM {jobs} j LEFT JOIN {companies} c ON c.id = j.company_id GROUP BY 1")
    top = A.capped(whole, 50, [F.desc("jobs"), F.asc("company")])
    return top.rows.withColumn("cut", top.cut.scalar())


@check(f"""WITH {ALL} SELECT count(*) AS jobs FROM jobs j WHERE EXISTS (SELECT 1 FROM job_skills js JOIN skills s ON s.id = js.skill_id WHERE js.job_id = j.id AND s.canonical_name ILIKE '%Ring%')
  AND j.title NOT ILIKE '%machinery%'""")
def ask_exists_skill(t):
    return asked(t, """SELECT count(*) AS jobs FROM {jobs} j WHERE EXISTS (SELECT 1 FROM {job_skills} js JOIN {skills} s ON s.id = js.skill_id
      WHERE js.job_id = j.id AND s.canonical_name ILIKE '%Ring%') AND j.title NOT ILIKE '%machinery%'""")


@check(f"WITH {ALL} SELECT location, count(*) AS jobs FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1")
def ask_jobs_per_location(t):
    return asked(t, "SELECT location, count(*) AS jobs FROM {jobs} GROUP BY 1 ORDER BY 2 DESC, 1")


@check(f"WITH {ALL} SELECT canonical_name, count(*) AS links FROM job_skills JOIN skills s ON s.id = skill_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def ask_top_skill(t):
    return A.query_views(t.spark, tables(t), "SELECT canonical_name, count(*) AS links FROM {job_skills} JOIN {skills} s ON s.id = skill_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")


@check(f"""WITH {ALL} SELECT count(*) AS urgent FROM jobs WHERE employment_type ILIKE '%urgent%' OR title ILIKE '%urgent%'""")
def ask_by_type_or_title(t):
    return asked(t, "SELECT count(*) AS urgent FROM {jobs} WHERE employment_type ILIKE '%urgent%' OR title ILIKE '%urgent%'")


@check(f"""WITH {ALL} SELECT employment_type, count(*) AS n, sum(experience_years_min) AS total, round(avg(experience_years_min), 6) AS mean, min(experience_years_min) AS low, max(experience_years_min) AS high
FROM jobs GROUP BY 1""")
def ask_aggregates(t):
    return asked(t, """SELECT employment_type, count(*) AS n, sum(experience_years_min) AS total, round(avg(experience_years_min), 6) AS mean, min(experience_years_min) AS low,
      max(experience_years_min) AS high FROM {jobs} GROUP BY 1""")


@check(f"""WITH {ALL} SELECT id, upper(title) AS u, lower(location) AS l, nullif(employment_type, '5-LOW') AS e, coalesce(company_id, -1) AS c, CAST(id AS VARCHAR) AS s,
  CAST(date_trunc('month', posted_at) AS DATE) AS month, extract(year FROM posted_at) AS year, round(id / 7.0, 2) AS r FROM jobs""")
def ask_scalar_functions(t):
    return asked(t, """SELECT id, upper(title) AS u, lower(location) AS l, nullif(employment_type, '5-LOW') AS e, coalesce(company_id, -1) AS c, CAST(id AS STRING) AS s,
      CAST(date_trunc('month', posted_at) AS DATE) AS month, CAST(extract(year FROM posted_at) AS BIGINT) AS year, CAST(round(id / 7.0, 2) AS DOUBLE) AS r FROM {jobs}""")


@check(f"""WITH {ALL}, recent AS (SELECT id, location FROM jobs WHERE posted_at >= (SELECT max(posted_at) - INTERVAL 365 DAY FROM jobs)) SELECT location, count(*) AS jobs FROM recent GROUP BY 1""")
def ask_recent_with(t):
    return asked(t, """WITH recent AS (SELECT id, location FROM {jobs} WHERE posted_at >= (SELECT max(posted_at) - INTERVAL 365 DAY FROM {jobs}))
      SELECT location, count(*) AS jobs FROM recent GROUP BY 1""")


SCOPE = f"""{ALL}, ids AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_quantity >= 48)"""


def scoped(t):
    return A.scope_to_jobs(A.curated(tables(t)), t.lineitem.where("l_quantity >= 48").select(F.col("l_orderkey").alias("job_id")))


@check(f"""WITH {SCOPE}, sj AS (SELECT * FROM jobs WHERE id IN (SELECT job_id FROM ids)), sl AS (SELECT * FROM job_skills WHERE job_id IN (SELECT job_id FROM ids))
SELECT 'jobs' AS relation, count(*) AS n FROM sj UNION ALL SELECT 'job_skills', count(*) FROM sl
UNION ALL SELECT 'companies', count(*) FROM companies WHERE id IN (SELECT company_id FROM sj) UNION ALL SELECT 'skills', count(*) FROM skills WHERE id IN (SELECT skill_id FROM sl)""")
def scope_relations(t):
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in scoped(t).items()]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


@check(f"""WITH {SCOPE} SELECT canonical_name, count(js.job_id) AS links FROM skills s JOIN job_skills js ON js.skill_id = s.id WHERE js.job_id IN (SELECT job_id FROM ids) GROUP BY 1""")
def scope_then_count(t):
    return A.query_views(t.spark, scoped(t), "SELECT s.canonical_name, count(js.job_id) AS links FROM {skills} s JOIN {job_skills} js ON js.skill_id = s.id GROUP BY 1")


@check(f"""WITH {BM25}, {DENSE}, {FUSED}, {ALL}, hit AS {ranked('fused', 'score DESC, best_rank, doc_id', 10)},
link AS (SELECT DISTINCT job_id, canonical_name FROM job_skills JOIN skills s ON s.id = skill_id)
SELECT query_id, canonical_name, count(*) AS jobs FROM hit JOIN link ON job_id = doc_id WHERE query_id % 10 <> 0 GROUP BY 1, 2
UNION ALL SELECT item_id, canonical_name, jobs FROM benchmark, (SELECT canonical_name, count(*) AS jobs FROM link GROUP BY 1) WHERE item_id % 10 = 0""")
def search_then_count(t):
    """Skills of the postings that a hybrid search found for each question; every tenth question asks about all postings."""
    asked_ = queries_of(t)
    hits = R.hybrid_search(asked_, docs_of(t), query_vectors(t), vectors_of(t), 10).select("query_id", F.col("doc_id").alias("job_id"))
    scope = F.when(F.col("query_id") % 10 == 0, "all").otherwise("search_results")

    def skills_held(relations, keys):
        named = relations["job_skills"].join(relations["skills"].select(F.col("id").alias("skill_id"), "canonical_name"), "skill_id")
        return named.select(*keys, "job_id", "canonical_name").distinct().groupBy(*keys, "canonical_name").agg(F.count("*").alias("jobs"))

    return A.search_then_count(asked_.withColumn("sql_scope", scope), hits, A.curated(tables(t)), skills_held)


RULES = """rules AS (SELECT n_nationkey AS query_id, 'skill' AS field, '%' || split_part(p_name, ' ', 1) || '%' AS pattern, true AS wanted FROM nation JOIN part ON p_partkey = n_nationkey * 3
  UNION ALL SELECT n_nationkey, 'title', '%' || c_mktsegment || ' eng%', n_nationkey % 2 = 0 FROM nation JOIN customer ON c_custkey = n_nationkey)"""


@check(f"""WITH {ALL}, {RULES}, hits AS (SELECT r.query_id, js.job_id, wanted FROM rules r JOIN skills s ON field = 'skill' AND s.canonical_name ILIKE pattern JOIN job_skills js ON js.skill_id = s.id
  UNION ALL SELECT r.query_id, j.id, wanted FROM rules r JOIN jobs j ON field = 'title' AND j.title ILIKE pattern)
SELECT query_id, job_id FROM hits GROUP BY 1, 2 HAVING bool_or(wanted) AND NOT bool_or(NOT wanted)""")
def silver_relevance(t):
    by_skill = t.nation.join(t.part, F.col("p_partkey") == F.col("n_nationkey") * 3).select(
        F.col("n_nationkey").alias("query_id"), F.lit("skill").alias("field"), F.concat(F.lit("%"), F.substring_index("p_name", " ", 1), F.lit("%")).alias("pattern"), F.lit(True).alias("wanted")
    )
    by_title = t.nation.join(t.customer, F.col("c_custkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("query_id"), F.lit("title").alias("field"), F.concat(F.lit("%"), "c_mktsegment", F.lit(" eng%")).alias("pattern"), (F.col("n_nationkey") % 2 == 0).alias("wanted")
    )
    return A.silver_labels(by_skill.unionByName(by_title), t.jobs, t.job_skills, t.skills)


@check("""SELECT vec_id AS query_id, label AS job_id FROM embeddings UNION ALL SELECT a.vec_id + 100000, b.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""")
def silver_paraphrases(t):
    labels = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("job_id"))
    same = t.embeddings.select((F.col("vec_id") + 100000).alias("query_id"), F.floor(F.col("vec_id") / 2).alias("same_relevance_as"))
    return A.copy_labels(labels, same)


@check("SELECT l_suppkey, round(median(l_extendedprice), 6) AS middle FROM lineitem GROUP BY 1")
def median_per_group(t):
    return K.median(t.lineitem, ["l_suppkey"], "l_extendedprice", "middle").withColumn("middle", F.round("middle", 6))


@check("SELECT round(median(l_extendedprice), 6) AS middle FROM lineitem")
def median_overall(t):
    return K.median(t.lineitem, [], "l_extendedprice", "middle").select(F.round("middle", 6).alias("middle"))


@check("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) AS p95 FROM r WHERE i = round_even((n - 1) * 0.95, 0) GROUP BY 1""")
def nearest_rank_p95(t):
    return K.nearest_rank(t.events, ["event_type"], "value", 0.95, "p95")


@check("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem""")
def position_in_hot_group(t):
    keyed = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    order = [F.asc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return K.position_in_group(keyed, ["l_suppkey"], order, F.date_trunc("month", "l_shipdate")).drop("l_shipdate")


@check("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1) // 8 + 1 AS batch FROM lineitem""")
def fixed_batches(t):
    keyed = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    order = [F.asc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return K.fixed_batches(keyed, ["l_suppkey"], order, F.date_trunc("month", "l_shipdate"), 8).drop("l_shipdate")


@check("SELECT l_suppkey, arg_min(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def first_per_group(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return K.first_per_key(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_partkey")


@check("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 50 AS v, l_returnflag AS f FROM lineitem),
g AS (SELECT k, list_distinct(list(v) FILTER (f = 'R')) AS a, list_distinct(list(v) FILTER (f = 'N')) AS b FROM s GROUP BY k)
SELECT k, coalesce(len(list_intersect(a, b)), 0) AS both_sets, coalesce(len(list_filter(coalesce(a, []), lambda x: NOT coalesce(list_contains(b, x), false))), 0) AS only_first,
  len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS either FROM g""")
def set_operations(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("v"), "l_returnflag")
    flags = rows.groupBy("k", "v").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("b"))
    return flags.groupBy("k").agg(F.count_if(F.expr("a and b")).alias("both_sets"), F.count_if(F.expr("a and not b")).alias("only_first"), F.count_if(F.expr("a or b")).alias("either"))


@check("""SELECT doc_id, substr(sha256(text), 1, 16) AS short_hash, length(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || ' ...' ELSE text END) AS chars FROM documents""")
def text_hash_and_truncate(t):
    return t.documents.select("doc_id", T.sha_hex("text", 16).alias("short_hash"), F.length(T.truncate("text")).cast("long").alias("chars"))

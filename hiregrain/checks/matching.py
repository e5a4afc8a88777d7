"""CVs against postings: customers with their orders, conversations with quoted words."""

from pyspark.sql import functions as F

from hiregrain.checks.registry import check, collapse, fold, key, named, tokens, words
from hiregrain.functions import text as T
from hiregrain.operators import matching as C

# An order asks for lineitem part numbers modulo 97; a customer has those of their even orders.
GAP_SQL = """job_skills AS (SELECT l_orderkey AS job_id, l_partkey % 97 AS skill_id,
  CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'N' THEN 'preferred' ELSE 'inferred' END AS requirement_type FROM lineitem),
skills AS (SELECT id, 'skill ' || id AS canonical_name FROM (SELECT DISTINCT l_partkey % 97 AS id FROM lineitem)),
pairs AS (SELECT o_custkey AS cv_id, o_orderkey AS job_id FROM orders),
cv_skills AS (SELECT DISTINCT o_custkey AS cv_id, skill_id FROM orders JOIN job_skills ON job_id = o_orderkey WHERE o_orderkey % 2 = 0 AND o_custkey % 3 <> 0),
req AS (SELECT job_id, skill_id, bool_or(requirement_type = 'required') AS is_required FROM job_skills WHERE requirement_type <> 'inferred' GROUP BY 1, 2),
need AS (SELECT p.cv_id, p.job_id, r.is_required, s.canonical_name AS n, c.skill_id IS NOT NULL AS has FROM pairs p LEFT JOIN req r ON r.job_id = p.job_id
  LEFT JOIN skills s ON s.id = r.skill_id LEFT JOIN cv_skills c ON c.cv_id = p.cv_id AND c.skill_id = r.skill_id),
counts AS (SELECT cv_id, job_id, count(*) FILTER (is_required) AS r, count(*) FILTER (is_required AND has) AS rh, count(*) FILTER (NOT is_required) AS p, count(*) FILTER (NOT is_required AND has) AS ph,
  string_agg(n, '|' ORDER BY n) FILTER (has AND is_required IS NOT NULL) AS matched, string_agg(n, '|' ORDER BY n) FILTER (is_required AND NOT has) AS missing_r,
  string_agg(n, '|' ORDER BY n) FILTER (NOT is_required AND NOT has) AS missing_p FROM need GROUP BY 1, 2),
gaps AS (SELECT *, CASE WHEN r > 0 AND p > 0 THEN round((0.8 * rh / r + 0.2 * ph / p) / 1.0, 4) WHEN r > 0 THEN round(rh / r, 4) WHEN p > 0 THEN round(ph / p, 4) ELSE 0.0 END AS fit_score FROM counts)"""


def gap_sides(t):
    kind = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "N", "preferred").otherwise("inferred")
    job_skills = t.lineitem.select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 97).alias("skill_id"), kind.alias("requirement_type"))
    ids = job_skills.select(F.col("skill_id").alias("id")).distinct()
    skills = ids.withColumn("canonical_name", F.concat(F.lit("skill "), F.col("id").cast("string")))
    pairs = t.orders.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"))
    own = pairs.where("job_id % 2 = 0 and cv_id % 3 <> 0").join(job_skills, "job_id").select("cv_id", "skill_id").distinct()
    return pairs, job_skills, skills, own


@check(f"WITH {GAP_SQL} SELECT * FROM req")
def cv_requirements(t):
    return C.requirements(gap_sides(t)[1])


@check(f"""WITH {GAP_SQL} SELECT cv_id, job_id, round(rh / nullif(r, 0), 6) AS required_coverage, round(ph / nullif(p, 0), 6) AS preferred_coverage, fit_score,
  coalesce(matched, '') AS matched, coalesce(missing_r, '') AS missing_required, coalesce(missing_p, '') AS missing_preferred FROM gaps""")
def cv_skill_gaps(t):
    gaps = C.skill_gaps(*gap_sides(t))
    joined = {"matched": "matched_skills", "missing_required": "missing_required_skills", "missing_preferred": "missing_preferred_skills"}
    return gaps.select(
        "cv_id", "job_id", F.round("required_coverage", 6).alias("required_coverage"), F.round("preferred_coverage", 6).alias("preferred_coverage"),
        "fit_score", *[F.array_join(c, "|").alias(n) for n, c in joined.items()],
    )


@check(f"""WITH {GAP_SQL}, jobs AS (SELECT cv_id, count(*) AS jobs FROM gaps GROUP BY cv_id),
missing AS (SELECT cv_id, CASE WHEN is_required THEN 'required' ELSE 'preferred' END AS kind, n AS skill FROM need WHERE is_required IS NOT NULL AND NOT has)
SELECT cv_id, kind, skill, round(count(*) / any_value(jobs), 6) AS frequency FROM missing JOIN jobs USING (cv_id) GROUP BY 1, 2, 3""")
def cv_missing_frequency(t):
    return C.missing_skill_frequency(C.skill_gaps(*gap_sides(t))).withColumn("frequency", F.round("frequency", 6))


@check("SELECT l_suppkey AS cv_id, min(l_orderkey) AS job_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cv_unknown_targets(t):
    targets = t.lineitem.select(F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("job_id"))
    return C.unknown_targets(targets, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@check(f"""WITH {GAP_SQL}, cosine AS (SELECT q.vec_id AS cv_id, d.vec_id AS job_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))
    / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))), 9) AS s
  FROM embeddings q CROSS JOIN embeddings d),
near AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY s DESC, job_id) AS rn FROM cosine QUALIFY rn <= 50),
need2 AS (SELECT n.cv_id, n.job_id, r.is_required, c.skill_id IS NOT NULL AS has FROM near n JOIN orders ON o_orderkey = n.job_id LEFT JOIN req r ON r.job_id = n.job_id
  LEFT JOIN cv_skills c ON c.cv_id = n.cv_id AND c.skill_id = r.skill_id),
c2 AS (SELECT cv_id, job_id, count(*) FILTER (is_required) AS r, count(*) FILTER (is_required AND has) AS rh, count(*) FILTER (NOT is_required) AS p, count(*) FILTER (NOT is_required AND has) AS ph FROM need2 GROUP BY 1, 2),
blended AS (SELECT cv_id, job_id, s AS semantic_score, CASE WHEN r > 0 AND p > 0 THEN round((0.8 * rh / r + 0.2 * ph / p) / 1.0, 4) WHEN r > 0 THEN round(rh / r, 4) WHEN p > 0 THEN round(ph / p, 4) ELSE 0.0 END AS fit_score FROM c2 JOIN near USING (cv_id, job_id)),
final AS (SELECT *, round(0.6 * semantic_score + 0.4 * fit_score, 9) AS final_score FROM blended)
SELECT cv_id, job_id, fit_score, final_score, row_number() OVER (PARTITION BY cv_id ORDER BY final_score DESC, semantic_score DESC, job_id) AS rank FROM final QUALIFY rank <= 10""")
def cv_match(t):
    pairs, job_skills, skills, own = gap_sides(t)
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    jobs = t.orders.select(F.col("o_orderkey").alias("id"))
    found = C.match_cvs(vectors.withColumnRenamed("doc_id", "cv_id"), vectors, jobs, job_skills, skills, own)
    return found.select("cv_id", "job_id", "fit_score", "final_score", "rank")


def claims_of(t):
    """Each user turn is a CV; it claims its words, quoted with the word that follows."""
    turns = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cv_id"), "text")
    listed = turns.select("cv_id", T.tokens("text").alias("w"))
    claims = listed.select("cv_id", F.posexplode("w").alias("seq", "name"), "w").select(
        "cv_id", "seq", "name", F.array_join(F.slice("w", F.col("seq") + 1, F.lit(2)), " ").alias("evidence")
    )
    # Every other token of a benchmark text is a skill, the token after it its alias.
    named_ = t.benchmark.select("item_id", F.posexplode(T.tokens("text")).alias("pos", "token"))
    numbered = named_.withColumn("skill_id", F.col("item_id") * 100_000 + F.col("pos") - F.col("pos") % 2)
    skills = numbered.where("pos % 2 = 0").select(F.col("skill_id").alias("id"), F.col("token").alias("canonical_name"))
    aliases = numbered.where("pos % 2 = 1").select("skill_id", F.col("token").alias("alias"))
    market = skills.where("id % 3 <> 0").select(F.col("id").alias("skill_id"))
    return claims, turns, skills, aliases, market


CLAIMS = f"""turns AS MATERIALIZED (SELECT conv_id * 1000 + turn AS cv_id, text, {fold(collapse('text'))} AS x, {tokens('text')} AS w FROM conversations WHERE role = 'user'),
listed AS (SELECT cv_id, x, w, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS seq FROM turns),
claims AS MATERIALIZED (SELECT cv_id, x, name, seq, array_to_string(list_slice(w, seq + 1, seq + 2), ' ') AS evidence FROM listed),
near AS MATERIALIZED (SELECT * FROM claims WHERE contains(x, evidence)),
quoted AS MATERIALIZED (SELECT cv_id, name, seq, evidence, {words('evidence')} AS ew FROM near WHERE {named('x', '[]', 'evidence').replace('CASE WHEN regexp_full_match(evidence, ', 'CASE WHEN false AND regexp_full_match(evidence, ')}),
numbered AS (SELECT item_id, unnest(w) AS n, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, {tokens('text')} AS w FROM benchmark)),
names AS MATERIALIZED (SELECT DISTINCT item_id * 100000 + pos - pos % 2 AS id, n FROM numbered),
known AS (SELECT {key('n')} AS key, min(id) AS skill_id FROM names GROUP BY 1),
resolved AS MATERIALIZED (SELECT q.*, k.skill_id, coalesce(k.skill_id % 3 <> 0, false) AS market FROM quoted q LEFT JOIN known k ON k.key = {key('q.name')})"""


@check(f"""WITH {CLAIMS}, ok AS (SELECT cv_id, skill_id, seq, evidence FROM resolved r WHERE market AND ({named('evidence', 'ew', 'name')}
  OR EXISTS (SELECT 1 FROM names w WHERE w.id = r.skill_id AND {named('r.evidence', 'r.ew', 'w.n')})))
SELECT cv_id, skill_id, arg_min(evidence, seq) AS evidence FROM ok GROUP BY 1, 2""")
def cv_recognized_skills(t):
    return C.recognize_skills(*claims_of(t))[0].select("cv_id", "skill_id", "evidence")


@check(f"WITH {CLAIMS} SELECT DISTINCT cv_id, name FROM resolved WHERE NOT market AND contains(evidence, name)")
def cv_unrecognized_claims(t):
    return C.recognize_skills(*claims_of(t))[1]


@check(r"""WITH parts AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS u, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS a,
  string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS s FROM conversations GROUP BY 1)
SELECT conv_id AS cv_id, concat_ws(chr(10), nullif(regexp_replace(coalesce(s, ''), '^\s+|\s+$', '', 'g'), ''), 'skill ' || conv_id,
  nullif(regexp_replace(coalesce(u, ''), '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(coalesce(a, ''), '^\s+|\s+$', '', 'g'), '')) AS query FROM parts""")
def cv_search_text(t):
    def texts(role):
        turns = F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))
        return F.transform(F.array_sort(turns), lambda x: x["text"])

    profiles = t.conversations.groupBy(F.col("conv_id").alias("cv_id")).agg(
        F.array_join(texts("system"), "\n").alias("summary"), texts("user").alias("projects"), texts("assistant").alias("experience")
    ).withColumn("education", F.array().cast("array<string>"))
    recognized = profiles.select("cv_id", F.lit(1).alias("seq"), F.concat(F.lit("skill "), F.col("cv_id").cast("string")).alias("skill"))
    return C.cv_query(profiles, recognized, max_chars=None)

"""Skill names over ``part``, ``lineitem``, ``documents`` and ``benchmark``."""

from pyspark.sql import functions as F

from hiregrain.checks.registry import JOB_SKILLS, SKILLS, WORD, check, collapse, fold, key, named, tokens, words
from hiregrain.functions import text as T
from hiregrain.operators import learning as L
from hiregrain.operators import merges as M
from hiregrain.operators import taxonomy as X

# Spellings of skills: a name with the size, and the brand with the type as its alias.
NAMES = """skills AS (SELECT p_partkey AS id, p_name || ' ' || p_size || ' ' || p_type AS canonical_name, p_type AS category,
  CASE WHEN p_size <= 10 THEN 'curated' ELSE 'extracted' END AS origin FROM part),
aliases AS (SELECT p_partkey AS skill_id, p_brand || '/' || p_size || p_type AS alias FROM part WHERE p_size > 5)"""


def spelled(t):
    skills = t.part.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type").alias("canonical_name"),
        F.col("p_type").alias("category"), F.when(F.col("p_size") <= 10, "curated").otherwise("extracted").alias("origin"),
    )
    aliases = t.part.where("p_size > 5").select(
        F.col("p_partkey").alias("skill_id"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), "p_type").alias("alias"),
        F.lit("curated").alias("source"), F.lit(None).cast("decimal(3,2)").alias("confidence"), F.lit(None).cast("string").alias("reason"),
    )
    return skills, aliases


def file_definitions(t):
    """The alias file: every brand is canonical for its numbered parts' names."""
    return t.part.where("p_size % 10 = 1").groupBy(F.col("p_name").alias("canonical")).agg(
        F.min("p_type").alias("category"), F.array_sort(F.collect_set(F.concat_ws("-", "p_name", "p_size"))).alias("aliases")
    )


def no_definitions(t):
    return t.part.where("false").select(F.col("p_name").alias("canonical"), F.col("p_type").alias("category"), F.array("p_name").alias("aliases"))


@check(f"SELECT DISTINCT p_name, {key('p_name')} AS name_key, {key('p_brand')} AS brand_key FROM part")
def skill_match_keys(t):
    return t.part.select("p_name", T.match_key("p_name").alias("name_key"), T.match_key("p_brand").alias("brand_key")).distinct()


@check(f"""WITH {NAMES}, names AS (SELECT id, canonical_name AS n FROM skills UNION ALL SELECT skill_id, alias FROM aliases)
SELECT {key('n')} AS key, min(id) AS skill_id FROM names GROUP BY 1""")
def skill_lookup(t):
    return X.lookup(*spelled(t))


def spaced(x: str) -> str:
    """Every mark set between blanks: a whole-word mention is then a plain substring between blanks."""
    return rf"' ' || regexp_replace({x}, '([^{WORD}])', ' \1 ', 'g') || ' '"


@check(f"""WITH docs AS MATERIALIZED (SELECT doc_id, {spaced(fold(collapse('text')))} AS x FROM documents),
listed AS (SELECT {tokens('text')} AS w FROM benchmark),
phrases AS (SELECT DISTINCT unnest(w) AS phrase FROM listed UNION SELECT DISTINCT '+' || unnest(w) FROM listed
  UNION SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM listed),
needles AS MATERIALIZED (SELECT phrase, {spaced('phrase')} AS needle FROM phrases)
SELECT doc_id, phrase FROM docs JOIN needles ON contains(x, needle)""")
def skill_mentions(t):
    """The catalog: every token of the benchmark texts, with a plus sign too, and every two tokens in a row."""
    w = F.col("w")
    pairs = F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    listed = t.benchmark.select(T.tokens("text").alias("w")).where(F.size("w") > 0)
    phrases = listed.select(F.explode(F.concat(w, F.transform(w, lambda x: F.concat(F.lit("+"), x)), pairs)).alias("phrase"))
    return X.named_anywhere(t.documents, phrases.distinct(), "doc_id", "text", "phrase")


def claims_of(t):
    """Postings: a document whose skills are the words of a benchmark text, required as they are and preferred backwards.

    The evidence is the document. Words of even length are known skills, with the word backwards as an alias.
    """
    said = t.benchmark.select("item_id", T.tokens("text").alias("w"))
    postings = t.documents.withColumn("item_id", F.col("doc_id") % t.benchmark.count()).join(said, "item_id").select(
        F.col("doc_id").alias("record_no"), F.col("w").alias("required_skills"), F.transform("w", F.reverse).alias("preferred_skills"), F.col("text").alias("evidence")
    )
    known = said.select("item_id", F.posexplode("w").alias("pos", "word")).where(F.length("word") % 2 == 0).withColumn("id", F.col("item_id") * 10_000 + F.col("pos"))
    skills = known.select("id", F.col("word").alias("canonical_name"), F.lit("curated").alias("origin"), F.lit("c").alias("category"))
    return postings, skills, known.select(F.col("id").alias("skill_id"), F.reverse("word").alias("alias"))


CLAIMS = f"""listed AS (SELECT item_id, {tokens('text')} AS w FROM benchmark),
docs AS MATERIALIZED (SELECT doc_id, w, {fold(collapse('text'))} AS ev, list_distinct({words(fold(collapse('text')))}) AS evw
  FROM documents JOIN listed ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
claims AS (SELECT doc_id AS job_id, 0 AS type_rank, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS name FROM docs
  UNION ALL SELECT doc_id, 1, generate_subscripts(w, 1) - 1, reverse(unnest(w)) FROM docs),
spelled AS MATERIALIZED (SELECT DISTINCT job_id, name FROM claims),
said AS MATERIALIZED (SELECT job_id, name, {named('ev', 'evw', 'name')} AS m FROM spelled JOIN docs ON doc_id = job_id),
keyed AS MATERIALIZED (SELECT claims.*, {key('name')} AS key, m FROM claims JOIN said USING (job_id, name) WHERE name <> '' AND length(name) <= 100),
toks AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM listed),
skills AS (SELECT item_id * 10000 + pos AS id, word AS n, reverse(word) AS a FROM toks WHERE length(word) % 2 = 0),
names AS (SELECT id, n FROM skills UNION SELECT id, a FROM skills),
known AS (SELECT {key('n')} AS key, min(id) AS skill_id FROM names GROUP BY 1),
found AS (SELECT * FROM keyed LEFT JOIN known USING (key)),
unknown AS (SELECT * FROM found WHERE skill_id IS NULL AND m AND length(name) <= 50),
created AS (SELECT key, arg_min(name, (job_id, type_rank, pos)) AS n, min((job_id, type_rank, pos)) AS o FROM unknown GROUP BY key),
numbered AS (SELECT *, (SELECT max(id) FROM skills) + row_number() OVER (ORDER BY o) AS id FROM created),
extended AS (SELECT key, skill_id, NULL AS o FROM known UNION ALL SELECT key, id, o FROM numbered),
wording AS (SELECT id, n FROM names UNION ALL SELECT id, n FROM numbered),
resolved AS MATERIALIZED (SELECT k.job_id, k.type_rank, k.pos, k.name, k.m, e.skill_id FROM keyed k JOIN extended e USING (key)
  WHERE e.o IS NULL OR (k.job_id, k.type_rank, k.pos) >= e.o),
accepted AS (SELECT job_id, type_rank, pos, name, skill_id FROM resolved WHERE m
  UNION ALL SELECT DISTINCT job_id, type_rank, pos, name, skill_id FROM resolved r JOIN wording w ON w.id = r.skill_id JOIN docs ON doc_id = job_id
  WHERE NOT m AND {named('ev', 'evw', 'w.n')})"""


@check(f"""WITH {CLAIMS} SELECT job_id, skill_id, CASE arg_min(type_rank, (type_rank, pos)) WHEN 0 THEN 'required' ELSE 'preferred' END AS requirement_type,
  arg_min(name, (type_rank, pos)) AS evidence_text FROM accepted GROUP BY job_id, skill_id""")
def skill_normalization(t):
    return X.normalize_skills(*claims_of(t)).links


@check(f"WITH {CLAIMS} SELECT id, n AS canonical_name, CAST(NULL AS VARCHAR) AS category, 'extracted' AS origin FROM numbered")
def skill_creation(t):
    return X.normalize_skills(*claims_of(t)).new_skills


@check(f"WITH {CLAIMS} SELECT DISTINCT job_id, name FROM unknown")
def skill_strict_unknown(t):
    return X.normalize_skills(*claims_of(t), create_missing=False).unknown


@check(f"""WITH {CLAIMS} SELECT job_id, type_rank, pos, name FROM found WHERE m AND length(name) <= 50 AND (skill_id IS NULL OR skill_id % 2 = 1)""")
def skill_learnable_names(t):
    postings, skills, aliases = claims_of(t)
    half = skills.withColumn("origin", F.when(F.col("id") % 2 == 1, "extracted").otherwise("curated"))
    claims = X.claimed_skills(postings, "record_no", "evidence")
    return X.learnable_names(claims, half, aliases).select("job_id", "type_rank", "pos", "name")


CONFLICT_FILE = "SELECT p_name AS canonical, unnest([p_name, p_brand || ' ' || p_size]) AS name FROM part"


@check(f"""SELECT {key('name')} AS key, min(canonical) AS first_owner, max(canonical) AS last_owner, count(DISTINCT canonical) AS owners
FROM ({CONFLICT_FILE}) GROUP BY 1 HAVING count(DISTINCT canonical) > 1""")
def skill_alias_conflicts(t):
    return X.alias_conflicts(t.part.select(F.col("p_name").alias("canonical"), F.array(F.concat_ws(" ", "p_brand", "p_size")).alias("aliases")))


@check(f"""WITH pairs AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part),
blocked AS (SELECT DISTINCT least({key('p_name')}, {key('p_type')}) AS low, greatest({key('p_name')}, {key('p_type')}) AS high FROM part WHERE p_size < 5)
SELECT p_partkey, a, b, EXISTS (SELECT 1 FROM blocked WHERE low = least({key('a')}, {key('b')}) AND high = greatest({key('a')}, {key('b')})) AS blocked FROM pairs""")
def skill_blocked_pairs(t):
    blocklist = X.blocked_pairs(t.part.where("p_size < 5"), "p_type", "p_name")
    pairs = t.part.select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return X.mark_blocked(pairs, "a", "b", blocklist)


@check("SELECT l_partkey AS skill_id, count(*) AS links FROM lineitem GROUP BY 1")
def skill_usage(t):
    return X.usage(t.job_skills)


@check("SELECT DISTINCT l_partkey AS skill_id FROM lineitem")
def skill_market(t):
    return X.market_skills(t.job_skills)


# Connected components by repeated reach; DuckDB follows members over shared keys.
COMPONENTS = f"""names AS (SELECT id, canonical_name AS n FROM skills UNION ALL SELECT skill_id, alias FROM aliases),
member AS (SELECT DISTINCT id, {key('n')} AS key FROM names),
hub AS (SELECT key, min(id) AS hub FROM member GROUP BY key),
edge AS (SELECT DISTINCT id, hub FROM member JOIN hub USING (key) WHERE id <> hub),
both_ways AS (SELECT id AS a, hub AS b FROM edge UNION SELECT hub, id FROM edge),
reach AS (SELECT id AS node, id AS seen FROM skills UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
component AS (SELECT node AS skill_id, min(seen) AS component FROM reach GROUP BY node)"""


@check(f"WITH RECURSIVE {NAMES}, {COMPONENTS} SELECT skill_id, component FROM component")
def skill_components(t):
    skills, aliases = spelled(t)
    return M.name_groups(skills, aliases, no_definitions(t), None)


PLAN = f"""{COMPONENTS}, {JOB_SKILLS}, links AS (SELECT skill_id, count(*) AS links FROM job_skills GROUP BY 1),
ranked AS (SELECT c.component, s.id, s.canonical_name, (CASE WHEN s.origin = 'curated' THEN 0 ELSE 1 END, -coalesce(l.links, 0), s.id) AS o, coalesce(l.links, 0) AS links
  FROM component c JOIN skills s ON s.id = c.skill_id LEFT JOIN links l ON l.skill_id = s.id),
kept AS (SELECT component, arg_min(id, o) AS keep_id, arg_min(canonical_name, o) AS keep_name, sum(links) AS affected, count(*) AS members FROM ranked GROUP BY component HAVING count(*) > 1),
plan AS (SELECT r.id AS skill_id, r.canonical_name, k.keep_id, k.keep_name, k.affected FROM ranked r JOIN kept k USING (component))"""


def merge_plan(t):
    skills, aliases = spelled(t)
    return M.plan_merges(skills, aliases, no_definitions(t), t.job_skills)


@check(f"WITH RECURSIVE {NAMES}, {PLAN} SELECT * FROM plan")
def skill_merge_plan(t):
    return merge_plan(t)


@check(f"""WITH RECURSIVE {NAMES}, {PLAN}, touched AS (SELECT j.id, j.job_id, p.keep_id AS skill_id, j.requirement_type, j.evidence_text,
    (CASE j.requirement_type WHEN 'required' THEN 0 ELSE 1 END, CASE WHEN j.skill_id = p.keep_id THEN 0 ELSE 1 END, j.id) AS o
  FROM job_skills j JOIN plan p ON p.skill_id = j.skill_id),
judged AS (SELECT *, o = min(o) OVER (PARTITION BY job_id, skill_id, requirement_type)
    AND NOT (requirement_type = 'preferred' AND bool_or(requirement_type = 'required') OVER (PARTITION BY job_id, skill_id)) AS kept,
  o = min(o) OVER (PARTITION BY job_id, skill_id) AS first FROM touched),
dropped AS (SELECT job_id, skill_id, list(evidence_text ORDER BY o) AS d FROM judged WHERE NOT kept GROUP BY 1, 2)
SELECT id, job_id, skill_id, requirement_type, CASE WHEN first AND d IS NOT NULL
  THEN list_reduce(list_prepend(evidence_text, d), lambda a, b: CASE WHEN a = b THEN a ELSE a || '; ' || b END) ELSE evidence_text END AS evidence_text
FROM judged LEFT JOIN dropped USING (job_id, skill_id) WHERE kept
UNION ALL SELECT id, job_id, skill_id, requirement_type, evidence_text FROM job_skills WHERE skill_id NOT IN (SELECT skill_id FROM plan)""")
def skill_merge_links(t):
    return M.merge_links(t.job_skills, merge_plan(t))


def merged(t):
    skills, aliases = spelled(t)
    return M.apply_merges(M.Taxonomy(skills, aliases, t.job_skills), merge_plan(t))


@check(f"WITH RECURSIVE {NAMES}, {PLAN} SELECT * FROM skills WHERE id NOT IN (SELECT skill_id FROM plan WHERE skill_id <> keep_id)")
def skill_merge_skills(t):
    return merged(t).skills


@check(f"""WITH RECURSIVE {NAMES}, {PLAN} SELECT coalesce(p.keep_id, a.skill_id) AS skill_id, a.alias, 'curated' AS source FROM aliases a LEFT JOIN plan p ON p.skill_id = a.skill_id
UNION ALL SELECT keep_id, canonical_name, 'merge' FROM plan WHERE skill_id <> keep_id AND canonical_name NOT IN (SELECT alias FROM aliases)""")
def skill_merge_aliases(t):
    return merged(t).aliases.select("skill_id", "alias", "source")


@check()
def skill_merge_plan_blocked(t):
    """With blocked pairs: a curated name must not join the names of the next size."""
    skills, aliases = spelled(t)
    sizes = t.part.select(
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type").alias("left"),
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), "p_type").alias("right"),
    ).where(F.crc32("left") % 3 == 0)
    return M.plan_merges(skills, aliases, no_definitions(t), t.job_skills, X.blocked_pairs(sizes, "left", "right"))


@check(f"""WITH {SKILLS}, file AS (SELECT p_name AS canonical, min(p_type) AS category FROM part WHERE p_size % 10 = 1 GROUP BY 1),
member AS (SELECT s.id, s.canonical_name, s.origin, f.canonical IS NOT NULL AS in_file, coalesce(f.category, s.category) AS category FROM skills s LEFT JOIN file f ON f.canonical = s.canonical_name),
links AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT arg_min(id, (CASE WHEN in_file OR origin = 'curated' THEN 0 ELSE 1 END, -coalesce(n, 0), id)) AS id, canonical_name,
  arg_min(category, (CASE WHEN in_file OR origin = 'curated' THEN 0 ELSE 1 END, -coalesce(n, 0), id)) AS category,
  CASE WHEN bool_or(in_file) THEN 'curated' ELSE arg_min(origin, (CASE WHEN in_file OR origin = 'curated' THEN 0 ELSE 1 END, -coalesce(n, 0), id)) END AS origin
FROM member LEFT JOIN links USING (id) GROUP BY canonical_name""")
def skill_seed(t):
    empty = t.part.where("false").select(
        F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("alias"), F.lit("curated").alias("source"),
        F.lit(None).cast("decimal(3,2)").alias("confidence"), F.lit(None).cast("string").alias("reason"),
    )
    return M.seed_taxonomy(M.Taxonomy(t.skills, empty, t.job_skills), file_definitions(t)).skills


@check()
def skill_nearest(t):
    """Ten most similar skills of every distinct document word that the taxonomy does not spell."""
    words = t.benchmark.select("item_id", F.explode(T.tokens("text")).alias("name")).withColumn("seq", F.col("item_id"))
    names = L.undecided(words, t.part.select(T.match_key("p_name").alias("match_key")))
    skills = t.skills.groupBy("canonical_name").agg(F.min("id").alias("id"), F.min("origin").alias("origin"))
    return L.nearest_skills(names, skills)


ANSWERS = f"""answers AS (SELECT {key("p_name || ' ' || p_partkey")} AS key, p_name || ' ' || p_partkey AS name,
  CASE WHEN p_size % 3 = 0 THEN 'new' ELSE 'same_as' END AS answer,
  CASE WHEN p_size % 3 <> 0 OR p_size % 2 = 0 THEN (p_partkey * 7) % (SELECT count(*) FROM part) END AS skill_id, round(p_retailprice % 100) / 100 AS confidence FROM part)"""


def answers_of(t):
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    total = t.part.agg(F.count("*").alias("n")).scalar()
    return t.part.select(
        T.match_key(name).alias("key"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, "new").otherwise("same_as").alias("answer"),
        F.when((F.col("p_size") % 3 != 0) | (F.col("p_size") % 2 == 0), F.col("p_partkey") * 7 % total).alias("skill_id"),
        (F.round(F.col("p_retailprice") % 100) / 100).alias("confidence"), F.col("p_type").alias("category"), F.lit("r").alias("reason"),
    )


@check(f"""WITH {SKILLS}, {ANSWERS},
blocked AS (SELECT DISTINCT least({key("p_name || ' ' || p_partkey")}, {key('p_name')}) AS low, greatest({key("p_name || ' ' || p_partkey")}, {key('p_name')}) AS high FROM part WHERE p_size < 25),
joined AS (SELECT a.*, coalesce({key('s.canonical_name')} <> a.key AND s.origin = 'curated', false) AS cand, coalesce({key('s.canonical_name')} = a.key, false) AS itself,
  EXISTS (SELECT 1 FROM blocked WHERE low = least(a.key, {key('s.canonical_name')}) AND high = greatest(a.key, {key('s.canonical_name')})) AS blocked
  FROM answers a LEFT JOIN skills s ON s.id = a.skill_id),
decided AS (SELECT *, CASE WHEN (answer = 'new' AND skill_id IS NULL) OR (answer = 'same_as' AND itself) THEN CASE WHEN confidence >= 0.7 THEN 'new' ELSE 'pending' END
  WHEN answer = 'same_as' AND cand AND NOT blocked AND confidence >= 0.9 THEN 'alias' ELSE 'pending' END AS decision FROM joined)
SELECT key, name, decision, CASE WHEN decision <> 'new' AND cand THEN skill_id END AS skill_id, confidence FROM decided""")
def skill_decisions(t):
    near = t.part.where("false").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("skill_id"))
    own = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    blocklist = X.blocked_pairs(t.part.where("p_size < 25").select(own.alias("a"), F.col("p_name").alias("b")), "a", "b")
    no_aliases = t.part.where("false").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("alias"))
    decided = L.decide(answers_of(t), t.skills, no_aliases, no_definitions(t), blocklist, near)
    return decided.select("key", "name", "decision", "skill_id", "confidence")


@check("""WITH asked AS (SELECT DISTINCT l_orderkey AS batch, l_partkey AS item FROM lineitem),
answered AS (SELECT l_orderkey AS batch, l_partkey AS item FROM lineitem WHERE l_quantity > 3),
bad AS (SELECT batch FROM (SELECT batch, item, count(*) AS n FROM answered GROUP BY 1, 2) FULL JOIN asked USING (batch, item) WHERE n IS NULL OR n > 1)
SELECT batch, CAST(item AS VARCHAR) AS key FROM answered WHERE batch NOT IN (SELECT batch FROM bad)""")
def skill_complete_batches(t):
    asked = t.lineitem.select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").cast("string").alias("key")).distinct()
    answered = t.lineitem.where("l_quantity > 3").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").cast("string").alias("key"))
    return L.complete_batches(asked, answered)


PROPOSALS = f"""proposals AS (SELECT {key("p_name || p_size || p_type")} AS key, p_name || ' ' || p_size || ' ' || p_type AS name, p_partkey,
  CASE WHEN p_partkey % 3 = 0 THEN 'alias' ELSE 'new' END AS decision, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7) % (SELECT count(*) FROM part) END AS skill_id FROM part),
once AS (SELECT arg_min(key, p_partkey) AS key, name, arg_min(decision, p_partkey) AS decision,
  CASE WHEN arg_min(decision, p_partkey) = 'alias' THEN arg_min(skill_id, p_partkey) END AS skill_id FROM proposals GROUP BY name)"""


def proposals_of(t):
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type")
    total = t.part.agg(F.count("*").alias("n")).scalar()
    alias = F.col("p_partkey") % 3 == 0
    rows = t.part.select(
        T.match_key(name).alias("key"), name.alias("name"), "p_partkey", F.when(alias, "alias").otherwise("new").alias("decision"),
        F.when(alias, F.col("p_partkey") * 7 % total).alias("skill_id"), F.lit(0.95).alias("confidence"), F.lit("c").alias("category"), F.lit("r").alias("reason"),
    )
    from hiregrain.plans.skew import first_per_key

    return first_per_key(rows, ["name"], ["p_partkey"]).drop("p_partkey")


@check(f"""WITH RECURSIVE {NAMES}, {PROPOSALS}, spelled AS (SELECT id, canonical_name AS n FROM skills UNION ALL SELECT skill_id, alias FROM aliases),
known AS (SELECT {key('n')} AS key, min(id) AS own FROM spelled GROUP BY 1),
chosen AS (SELECT o.*, k.own FROM once o LEFT JOIN known k USING (key) WHERE o.decision = 'alias'),
edge AS (SELECT own AS a, skill_id AS b FROM chosen WHERE own IS NOT NULL UNION SELECT skill_id, own FROM chosen WHERE own IS NOT NULL UNION SELECT skill_id, skill_id FROM chosen),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
links AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
best AS (SELECT component, arg_min(c.node, (CASE WHEN s.origin = 'curated' THEN 0 ELSE 1 END, -coalesce(l.n, 0), c.node)) AS canonical
  FROM component c JOIN skills s ON s.id = c.node LEFT JOIN links l ON l.id = c.node GROUP BY component)
SELECT name, CASE WHEN own = canonical THEN 'new' ELSE 'alias' END AS decision, CASE WHEN own IS DISTINCT FROM canonical THEN canonical END AS skill_id
FROM chosen JOIN component ON node = skill_id JOIN best USING (component)
UNION ALL SELECT name, decision, skill_id FROM once WHERE decision <> 'alias'""")
def skill_consolidation(t):
    skills, aliases = spelled(t)
    return L.consolidate(proposals_of(t), skills, aliases, no_definitions(t), t.job_skills).select("name", "decision", "skill_id")


def learned_state(t):
    """Apply the consolidated proposals to a taxonomy without decisions."""
    skills, aliases = spelled(t)
    decisions = t.part.where("false").select(
        F.col("p_name").alias("match_key"), F.col("p_name").alias("name"), F.col("p_type").alias("decision"), F.col("p_partkey").alias("skill_id"),
        F.lit(None).cast("decimal(3,2)").alias("confidence"), F.col("p_type").alias("reason"), F.col("p_type").alias("model"),
    )
    state = M.Taxonomy(skills, aliases, t.job_skills.withColumn("evidence_text", F.concat_ws(" ", F.lit("uses"), "evidence_text")), decisions)
    none = X.blocked_pairs(t.part.where("false"), "p_name", "p_type")
    proposals = L.consolidate(proposals_of(t), skills, aliases, no_definitions(t), t.job_skills)
    return L.apply_decisions(state, proposals, no_definitions(t), none, model="m")


@check()
def skill_apply_decisions(t):
    return learned_state(t)[0].decisions


@check()
def skill_revert_aliases(t):
    state, _ = learned_state(t)
    one = state.aliases.where("source = 'llm'").groupBy("skill_id").agg(F.min("alias").alias("name"))
    return L.revert_aliases(state, one)[1]


DECISIONS = f"""decisions AS (SELECT {key("p_name || p_partkey")} AS match_key, p_name || p_partkey AS name,
  CASE p_size % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'new' ELSE 'alias' END AS decision, 'r' AS reason FROM part)"""


def decisions_of(t):
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    kind = F.when(F.col("p_size") % 3 == 0, "pending").when(F.col("p_size") % 3 == 1, "new").otherwise("alias")
    return t.part.select(T.match_key(name).alias("match_key"), name.alias("name"), kind.alias("decision"), F.lit("r").alias("reason"), F.col("p_partkey").alias("skill_id"))


@check(f"WITH {DECISIONS} SELECT match_key, name FROM decisions WHERE decision = 'pending'")
def skill_review_list(t):
    return L.review_list(decisions_of(t), "pending").select("match_key", "name")


@check(f"""WITH {DECISIONS}, keep AS (SELECT {key("p_name || p_partkey")} AS k FROM part WHERE p_size % 2 = 0)
SELECT match_key, CASE WHEN decision = 'pending' AND match_key IN (SELECT k FROM keep) THEN 'new' ELSE decision END AS decision,
  CASE WHEN decision = 'pending' AND match_key IN (SELECT k FROM keep) THEN 'Kept as a distinct skill by reviewer.' ELSE reason END AS reason FROM decisions""")
def skill_keep_pending(t):
    names = t.part.where("p_size % 2 = 0").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return L.keep_pending_as_new(decisions_of(t), names).select("match_key", "decision", "reason")


@check(f"""WITH {SKILLS}, {DECISIONS}, known AS (SELECT {key('canonical_name')} AS k, min(id) AS skill_id FROM skills GROUP BY 1),
own AS (SELECT {key("p_name || p_partkey")} AS match_key, p_partkey, p_name FROM part)
SELECT d.name, 'alias' AS decision, k.skill_id FROM decisions d JOIN own USING (match_key) JOIN known k ON k.k = {key('own.p_name')}
WHERE d.decision = 'pending' AND k.skill_id <> own.p_partkey""")
def skill_approve_pending(t):
    no_aliases = t.part.where("false").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("alias"))
    state = M.Taxonomy(t.skills, no_aliases, t.job_skills, decisions_of(t))
    requests = t.part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("canonical"))
    return L.approve_pending(requests, state).select("name", "decision", "skill_id")

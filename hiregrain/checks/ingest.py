"""Cleaning, hashing and deduplication over ``documents``, ``pages``, ``part`` and ``customer``."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hiregrain.checks.registry import check, collapse, fold
from hiregrain.functions import text as T
from hiregrain.operators import ingest as I
from hiregrain.plans.graphs import keep_first_on_both
from hiregrain.session import materialize, shared_folder
from hiregrain.sources.files import json_fields
from hiregrain.sources.json_list import read_json_list


@check(f"SELECT doc_id, sha256({collapse('text')}) AS cleaned, length({collapse('text')}) AS chars FROM documents")
def ingest_clean_text(t):
    cleaned = t.documents.select("doc_id", T.clean("text").alias("c"))
    return cleaned.select("doc_id", T.sha_hex("c").alias("cleaned"), F.length("c").cast("long").alias("chars"))


@check("""SELECT CAST(doc_id AS VARCHAR) AS title, sha256(text) AS description, CASE WHEN doc_id % 2 = 0 THEN source END AS company, lang, (SELECT count(*) FROM documents) AS records FROM documents""")
def ingest_json_files(t):
    """Documents written as files that are one JSON list each, and read again from byte ranges of a megabyte."""
    folder = f"{shared_folder(t.spark)}/lists-{uuid.uuid4().hex}.json"
    record = F.to_json(F.struct(F.col("doc_id").alias("Title"), F.col("text").alias("job_description"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("company"), "lang"))
    place = Window.partitionBy("file").orderBy("doc_id")
    listed = t.documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("file"), "doc_id", record.alias("r")).select(
        "file", F.row_number().over(place).alias("n"), F.count("*").over(Window.partitionBy("file")).alias("size"), "r"
    )
    ends = F.when(F.col("n") == F.col("size"), "]").otherwise(",")
    lines = listed.sortWithinPartitions("file", "n").select("file", F.concat(F.when(F.col("n") == 1, "[").otherwise(""), "r", ends).alias("value"))
    lines.write.partitionBy("file").text(folder)
    read = json_fields(read_json_list(t.spark, folder, size=1 << 20))
    total = read.agg(F.max("record_no")).scalar()
    return read.select(F.col("extra")["Title"].alias("title"), T.sha_hex("description").alias("description"), "company", F.col("extra")["lang"].alias("lang"), total.alias("records"))


MARKERS = "CASE o_orderstatus WHEN 'P' THEN '  N/a ' WHEN 'F' THEN o_orderpriority ELSE 'none' || o_orderpriority END"


@check(f"""SELECT o_orderkey, CASE WHEN lower(trim(v)) NOT IN ('', 'n/a', 'na', 'none', 'null') THEN trim(v) END AS value
FROM (SELECT o_orderkey, {MARKERS} AS v FROM orders)""")
def ingest_missing_markers(t):
    return t.orders.select("o_orderkey", T.clean(F.expr(MARKERS)).alias("value"))


@check(r"""SELECT doc_id, sha256(array_to_string(l, chr(10))) AS cleaned, len(l) AS lines FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
    lambda x: lower(x) NOT IN ('', 'n/a', 'na', 'none', 'null')) AS l FROM documents)""")
def ingest_skill_lines(t):
    cleaned = t.documents.select("doc_id", T.clean_lines("text").alias("c"))
    return cleaned.select("doc_id", T.sha_hex("c").alias("cleaned"), F.size(F.split("c", "\n")).cast("long").alias("lines"))


# DuckDB's regular expressions have no lookahead; commas inside parentheses do not occur in this table.
@check(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;\n]'), lambda x: trim(x)),
    lambda x: x <> '' AND length(x) <= 100) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM s),
f AS (SELECT doc_id, arg_min(x, pos) AS x, min(pos) AS pos FROM u GROUP BY doc_id, {fold(collapse('x'))})
SELECT doc_id, count(x) AS skills, sha256(coalesce(string_agg(x, '|' ORDER BY pos), '')) AS listed
FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def ingest_skill_list(t):
    parsed = t.documents.select("doc_id", T.parse_skill_list("text").alias("l"))
    return parsed.select("doc_id", F.size("l").cast("long").alias("skills"), T.sha_hex(F.array_join("l", "|")).alias("listed"))


PHRASE = """CASE p_size % 6 WHEN 0 THEN p_size || ' năm' WHEN 1 THEN p_size || ' months of work' WHEN 2 THEN ' ' || p_size || ' YRS+'
  WHEN 3 THEN 'Không yêu cầu' WHEN 4 THEN CAST(p_size AS STRING) ELSE p_name END"""


@check(rf"""SELECT p_partkey, CASE WHEN regexp_full_match(v, '\s*\d+\s*') THEN CAST(trim(v) AS INTEGER)
  WHEN lower(trim(v)) IN ('không yêu cầu', 'no experience') THEN 0
  WHEN regexp_matches(v, '(?i)^\s*\d+\s*(năm|years?|yrs?)([^\p{{L}}\p{{N}}_]|$)') THEN CAST(regexp_extract(v, '\d+') AS INTEGER)
  WHEN regexp_matches(v, '(?i)^\s*\d+\s*(tháng|months?)([^\p{{L}}\p{{N}}_]|$)') THEN CAST(regexp_extract(v, '\d+') AS INTEGER) // 12
  END AS years FROM (SELECT p_partkey, {PHRASE.replace('STRING', 'VARCHAR')} AS v FROM part)""")
def ingest_experience(t):
    return t.part.select("p_partkey", T.parse_experience(F.expr(PHRASE)).alias("years"))


def page_records(t):
    return t.pages.select(
        F.col("page_id").alias("record_no"),
        F.when(F.col("page_id") % 11 != 0, F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.when(F.col("page_id") % 13 != 0, F.col("html")).alias("description"),
        F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("source_url"),
        (F.col("page_id") % 9 - 1).cast("int").alias("experience_years_min"),
    )


@check("""SELECT page_id AS record, CASE WHEN page_id % 11 = 0 THEN 'title: title is required'
  WHEN page_id % 9 - 1 < 0 THEN 'experience_years_min: must not be negative'
  WHEN page_id % 13 = 0 THEN 'description: description is required'
  ELSE 'source_url: not a valid http(s) URL' END AS error
FROM pages WHERE page_id % 11 = 0 OR page_id % 9 = 0 OR page_id % 13 = 0 OR page_id % 7 = 0""")
def ingest_quarantine(t):
    return I.check(page_records(t), I.extracted_rules())[1]


@check("""SELECT count(*) AS good FROM pages WHERE page_id % 11 <> 0 AND page_id % 9 <> 0 AND page_id % 13 <> 0 AND page_id % 7 <> 0""")
def ingest_valid_rows(t):
    return I.check(page_records(t), I.extracted_rules())[0].agg(F.count("*").alias("good"))


def raw_documents(t):
    """Documents as raw postings: near copies share a url, a third name no skills."""
    return t.documents.select(
        (F.col("doc_id") + 1).alias("record_no"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.upper("source").alias("company_name"),
        F.col("lang").alias("location"),
        F.col("text").alias("description_text"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("https://jobs.example.com/"), F.sha2(T.collapse("text"), 256))).alias("source_url"),
        F.when(F.col("doc_id") % 3 != 0, F.lit("alpha; beta (gamma, delta)\n n/a")).alias("required_skills"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("18 months")).alias("experience"),
    )


CLEANED = f"""cleaned AS (SELECT doc_id + 1 AS record_no, source || ' ' || lang AS title, upper(source) AS company, lang AS location,
  {collapse('text')} AS description, CASE WHEN n_chars % 2 = 0 THEN 'https://jobs.example.com/' || sha256({collapse('text')}) END AS source_url,
  CASE WHEN doc_id % 3 <> 0 THEN 'alpha; beta (gamma, delta)' END AS required_skills,
  CASE WHEN doc_id % 2 = 0 THEN '18 months' END AS experience FROM documents)"""


def j(x: str) -> str:
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


RAW_HASH = f"""sha256('{{"company":' || {j('company')} || ',"description":' || {j('description')} || ',"employment_type":null,"experience":' || {j('experience')}
  || ',"experience_years_min":null,"location":' || {j('location')} || ',"preferred_skills":null,"required_skills":' || {j('required_skills')}
  || ',"source_record_hash":null,"source_url":' || {j('source_url')} || ',"technical_skills":null,"title":' || {j('title')} || '}}')"""


@check(f"WITH {CLEANED} SELECT record_no, {RAW_HASH} AS raw_hash FROM cleaned")
def ingest_raw_hash(t):
    cleaned = I.clean_records(raw_documents(t))
    return cleaned.select("record_no", I.raw_hash(cleaned).alias("raw_hash"))


CONTENT_HASH = f"""sha256('{{"company":' || {j('lower(company)')} || ',"description":' || {j('description')} || ',"employment_type":null,"experience_years_min":'
  || CASE WHEN experience IS NULL THEN 'null' ELSE '1' END || ',"location":' || {j('lower(location)')} || ',"title":' || {j('lower(title)')} || '}}')"""


@check(f"WITH {CLEANED} SELECT record_no, {CONTENT_HASH} AS content_hash FROM cleaned WHERE required_skills IS NOT NULL")
def ingest_content_hash(t):
    done, _ = I.extract_structured(I.clean_records(raw_documents(t)))
    return done.select("record_no", I.content_hash().alias("content_hash"))


@check(f"""WITH {CLEANED} SELECT record_no, title, company, 1 AS years, 'alpha|beta (gamma, delta)' AS required
FROM cleaned WHERE required_skills IS NOT NULL AND experience IS NOT NULL UNION ALL
SELECT record_no, title, company, NULL, 'alpha|beta (gamma, delta)' FROM cleaned WHERE required_skills IS NOT NULL AND experience IS NULL""".replace(
    "beta (gamma, delta)' AS required", "gamma|delta' AS required").replace("'alpha|beta (gamma, delta)'", "'alpha|gamma|delta'"))
def ingest_structured(t):
    done, _ = I.extract_structured(I.clean_records(raw_documents(t)))
    return done.select(
        "record_no", "title", "company", F.col("experience_years_min").alias("years"), F.array_join("required_skills", "|").alias("required")
    )


# A row with a url duplicates by url, one without by hash; equal hashes imply equal urls here.
KEPT = f"""{CLEANED}, hashed AS (SELECT *, {RAW_HASH} AS raw_hash FROM cleaned),
prepared AS (SELECT * FROM hashed WHERE record_no IN (SELECT min(record_no) FROM hashed GROUP BY coalesce(source_url, raw_hash)))"""


def hashed_documents(t):
    cleaned = I.clean_records(raw_documents(t))
    return cleaned.withColumn("raw_hash", I.raw_hash(cleaned)).select("record_no", "raw_hash", "source_url")


@check(f"WITH {KEPT} SELECT record_no, raw_hash FROM prepared")
def ingest_dedup(t):
    return I.drop_duplicates_on(hashed_documents(t), None, "raw_hash").select("record_no", "raw_hash")


@check(f"""WITH {CLEANED}, hashed AS (SELECT *, {RAW_HASH} AS raw_hash FROM cleaned),
stored AS (SELECT raw_hash, source_url FROM hashed WHERE record_no % 4 = 0),
fresh AS (SELECT * FROM hashed WHERE raw_hash NOT IN (SELECT raw_hash FROM stored)
  AND (source_url IS NULL OR source_url NOT IN (SELECT source_url FROM stored WHERE source_url IS NOT NULL)))
SELECT min(record_no) AS record_no FROM fresh GROUP BY coalesce(source_url, raw_hash)""")
def ingest_dedup_against_stored(t):
    hashed = materialize(hashed_documents(t))  # it stands on both sides
    return I.drop_duplicates_on(hashed, hashed.where("record_no % 4 = 0"), "raw_hash").select("record_no")


@check()
def ingest_dedup_two_keys(t):
    rows = t.orders.select(F.col("o_orderkey").alias("record_no"), "o_custkey", "o_orderdate")
    return keep_first_on_both(rows, "record_no", "o_custkey", "o_orderdate")


@check(f"""WITH {KEPT}, final AS (SELECT *, {CONTENT_HASH} AS content_hash FROM prepared WHERE required_skills IS NOT NULL)
SELECT (SELECT count(*) FROM cleaned) AS processed,
  (SELECT count(DISTINCT coalesce(source_url, content_hash)) FROM final) AS inserted,
  (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM prepared) + (SELECT count(*) - count(DISTINCT coalesce(source_url, content_hash)) FROM final) AS skipped_duplicates,
  (SELECT count(*) FROM prepared WHERE required_skills IS NULL) AS failed,
  (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM prepared) AS skipped_before_model,
  (SELECT count(*) FROM final) AS deterministic,
  (SELECT count(*) FROM prepared WHERE required_skills IS NULL) AS model_records""")
def ingest_import_summary(t):
    return I.import_postings(raw_documents(t)).summary()


@check("""WITH posted AS (SELECT c_custkey AS record_no, CASE WHEN c_custkey % 2 = 0 THEN upper(s_name) ELSE n_name END AS company
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_suppkey = c_custkey % 7),
fresh AS (SELECT arg_min(company, record_no) AS name, min(record_no) AS first_no FROM posted
  WHERE lower(company) NOT IN (SELECT lower(s_name) FROM supplier) GROUP BY lower(company))
SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY first_no), name FROM fresh""")
def ingest_companies(t):
    posted = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.supplier, F.col("s_suppkey") == F.col("c_custkey") % 7)
        .select(F.col("c_custkey").alias("record_no"), F.when(F.col("c_custkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("n_name")).alias("company"))
    )
    stored = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return I.add_companies(stored, posted)


@check(r"SELECT page_id, sha256(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS text FROM pages")
def ingest_strip_comments(t):
    return t.pages.select("page_id", T.sha_hex(T.strip_comments("html")).alias("text"))


# The named characters that occur in this table.
@check(r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
  '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def ingest_markup_text(t):
    return t.pages.select("page_id", T.markup_to_text("html").alias("text"))


@check(f"""WITH {CLEANED} SELECT record_no, sha256('{{"title":' || {j('title')} || ',"company":' || {j('company')} || ',"location":' || {j('location')}
  || ',"employment_type":null,"description":' || {j('description')} || ',"source_url":' || {j('source_url')} || ',"technical_skills":null}}') AS request,
  sha256(title || ' ' || description || ' ') AS evidence FROM cleaned""")
def ingest_model_request(t):
    cleaned = I.clean_records(raw_documents(t))
    return cleaned.select("record_no", T.sha_hex(I.model_request()).alias("request"), T.sha_hex(I.evidence_text()).alias("evidence"))


@check("""SELECT doc_id AS record_no, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'model title' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'model place' END AS location, CAST(NULL AS VARCHAR) AS employment_type,
  CAST(NULL AS VARCHAR) AS source_url, CASE WHEN doc_id % 5 = 0 THEN source END AS company, sha256(text) AS description, n_chars AS score FROM documents""")
def ingest_source_facts(t):
    none = F.lit(None).cast("string")
    records = t.documents.select(
        F.col("doc_id").alias("record_no"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("location"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("company"),
        none.alias("employment_type"), none.alias("source_url"), F.col("text").alias("description"),
    )
    answered = t.documents.select(
        F.col("doc_id").alias("record_no"), F.lit("model title").alias("title"), F.lit("model place").alias("location"),
        F.lit("model company").alias("company"), none.alias("employment_type"), none.alias("source_url"), F.col("n_chars").alias("score"),
    )
    return I.keep_source_facts(answered, records).withColumn("description", T.sha_hex("description"))

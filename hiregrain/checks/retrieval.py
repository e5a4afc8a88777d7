"""Search over ``documents``, ``benchmark`` and ``embeddings``; search documents and index over ``orders``."""

import uuid

from pyspark.sql import functions as F

from hiregrain.checks.registry import COMPANIES, JOB_SKILLS, JOBS, SKILLS, check, fold, tokens, words
from hiregrain.functions import text as T
from hiregrain.functions.vectors import l2_normalize, norm, split_by_dimension
from hiregrain.operators import dense as D
from hiregrain.operators import documents as S
from hiregrain.operators import fusion as R
from hiregrain.operators import inference as I
from hiregrain.operators import keyword as K
from hiregrain.operators import keyword_index as X
from hiregrain.operators import metrics as E
from hiregrain.session import shared_folder
from hiregrain.sources.files import read_version, write_version


def docs_of(t):
    return t.documents.select("doc_id", "text")


def queries_of(t):
    """A query is a benchmark passage."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


QUERY = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


@check(f"SELECT count(*) AS documents, round(avg(len({tokens('text')})), 6) AS average_length FROM documents")
def search_corpus_statistics(t):
    return K.corpus_statistics(docs_of(t)).withColumn("average_length", F.round("average_length", 6))


@check(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token")
def search_document_frequency(t):
    return K.document_frequency(docs_of(t))


BM25 = f"""{QUERY}, term AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({tokens('text')}) AS token FROM queries) GROUP BY 1, 2),
doc AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM doc) GROUP BY doc_id, dl, token),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM doc),
freq AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm25 AS MATERIALIZED (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) AS score
  FROM term JOIN tf USING (token) JOIN freq USING (token), corpus GROUP BY 1, 2)"""


@check(f"WITH {BM25} SELECT query_id, doc_id, score FROM bm25")
def search_bm25_scores(t):
    return K.bm25_scores(queries_of(t), docs_of(t))


def ranked(source: str, order: str, k: int, key: str = "query_id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {k})"


@check(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM {ranked('bm25', 'score DESC, doc_id', 10)}")
def search_bm25_top_k(t):
    return K.bm25_top_k(queries_of(t), docs_of(t), 10)


def index_of(t):
    """The stored index of the documents table as it is now; written when it is asked for first."""
    files = t.documents.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    stamp = files.agg(F.coalesce(F.bit_xor("f"), F.lit(0))).first()[0]
    folder = f"{shared_folder(t.spark)}/keyword-{stamp & (1 << 63) - 1:x}"
    return X.open_index(t.spark, folder) or X.write_index(docs_of(t), folder)


@check(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM {ranked('bm25', 'score DESC, doc_id', 10)}")
def search_bm25_indexed(t):
    """The same ranking from a stored index; a second call finds it written."""
    return index_of(t).top_k(queries_of(t), 10)


@check(f"""WITH {BM25}, wanted AS (SELECT bm25.* FROM bm25 JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 300)
SELECT query_id, doc_id, rank FROM {ranked('wanted', 'score DESC, doc_id', 20)}""")
def search_filtered_indexed(t):
    within = R.matching_documents(t.documents, F.col("lang") == "en", F.col("n_chars") > 300)
    return index_of(t).top_k(queries_of(t), 20, within=within).select("query_id", "doc_id", "rank")


@check("WITH w AS (SELECT doc_id, " + tokens('text') + " AS w FROM documents) SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS token FROM w) GROUP BY 1")
def search_indexed_terms(t):
    """Document frequencies as the index holds them."""
    return index_of(t).terms().select("token", "df")


@check(rf"""WITH {QUERY}, extra AS (SELECT query_id, list_concat({tokens('text')}, regexp_extract_all(lower(text), '[a-z]+ing')) AS w FROM queries)
SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(w) AS token FROM extra) GROUP BY 1, 2""")
def search_extra_terms(t):
    tokenizer = K.with_extra_terms(lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+ing"), F.lit(0)))
    return K.query_terms(queries_of(t), tokenizer)


def query_vectors(t):
    """Every tenth label-mate asks: a vector whose id is also a benchmark item."""
    return t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "embedding")


def vectors_of(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


DENSE = """pairs AS (SELECT item_id AS query_id, d.vec_id AS doc_id,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
    * sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))), 9) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings d)"""


@check(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM {ranked('pairs', 'score DESC, doc_id', 10)}")
def search_dense_top_k(t):
    found = D.dense_top_k(query_vectors(t), D.require_index(vectors_of(t), 64), 10)
    return found


@check(f"WITH {DENSE.replace('FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS', 'FROM embeddings q CROSS').replace('item_id AS', 'q.vec_id AS')} SELECT query_id, doc_id, rank FROM {ranked('pairs', 'score DESC, doc_id', 5)}")
def search_dense_blocks(t):
    """Every vector against every vector."""
    every = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return D.dense_top_k(every, vectors_of(t), 5).select("query_id", "doc_id", "rank")


@check("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squared, true AS unit FROM embeddings")
def vector_normalization(t):
    good, _ = split_by_dimension(t.embeddings, "embedding", 64)
    unit = good.withColumn("u", l2_normalize("embedding"))
    return unit.select("vec_id", F.round(norm("embedding") * norm("embedding"), 6).alias("squared"), (F.abs(norm("u") - 1) < 1e-9).alias("unit"))


@check("SELECT count(*) AS quarantined FROM embeddings WHERE len(embedding) <> 32")
def vector_dimension_check(t):
    return split_by_dimension(t.embeddings, "embedding", 32)[1].agg(F.count("*").alias("quarantined"))


FUSED = f"""k AS {ranked('bm25', 'score DESC, doc_id', 20)}, d AS {ranked('pairs', 'score DESC, doc_id', 20)},
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM (SELECT query_id, doc_id, rank FROM k UNION ALL SELECT query_id, doc_id, rank FROM d) GROUP BY 1, 2)"""


@check(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, score, best_rank, rank FROM {ranked('fused', 'score DESC, best_rank, doc_id', 10)}")
def search_hybrid(t):
    found = R.hybrid_search(queries_of(t), docs_of(t), query_vectors(t), vectors_of(t), 10)
    return found


EVENTS_RANKED = """ranked AS (SELECT user_id AS query_id, source, event_id % 40 AS doc_id, row_number() OVER (PARTITION BY user_id, source ORDER BY value DESC, event_id) AS rank
  FROM (SELECT *, event_type AS source FROM events WHERE event_type IN ('view', 'click', 'purchase')))"""


@check(f"""WITH {EVENTS_RANKED}, once AS (SELECT query_id, source, doc_id, min(rank) AS rank FROM ranked GROUP BY 1, 2, 3),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best_rank,
  arg_min(source, CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS label FROM once GROUP BY 1, 2)
SELECT query_id, doc_id, score, best_rank, label, rank FROM {ranked('fused', 'score DESC, best_rank, doc_id', 5)}""")
def search_rank_fusion(t):
    """Three rankings with repeated documents; the first ranking that holds a document labels it."""
    from hiregrain.plans.skew import position_in_group

    numbered = position_in_group(
        t.events.withColumn("query_id", F.col("user_id")).withColumn("label", F.col("event_type")),
        ["query_id", "label"], [F.desc("value"), F.asc("event_id")], -F.floor(F.col("value")),
        "rank",
    ).withColumn("doc_id", F.col("event_id") % 40)
    rankings = [numbered.where(F.col("label") == s) for s in ("view", "click", "purchase")]
    return R.reciprocal_rank_fusion(rankings, 5, payload=["label"])


@check(f"""WITH {BM25}, wanted AS (SELECT bm25.* FROM bm25 JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 300)
SELECT query_id, doc_id, rank FROM {ranked('wanted', 'score DESC, doc_id', 20)}""")
def search_filtered_hits(t):
    """The filter comes before the cut, so a query gets 20 hits if 20 documents match."""
    within = R.matching_documents(t.documents, F.col("lang") == "en", F.col("n_chars") > 300)
    return K.bm25_top_k(queries_of(t), docs_of(t), 20, within=within).select("query_id", "doc_id", "rank")


@check(f"""WITH {BM25}, {DENSE}, wanted AS (SELECT doc_id FROM documents WHERE lang = 'en'),
kw AS (SELECT bm25.* FROM bm25 JOIN wanted USING (doc_id)), dw AS (SELECT pairs.* FROM pairs JOIN wanted USING (doc_id)),
k AS {ranked('kw', 'score DESC, doc_id', 20)}, d AS {ranked('dw', 'score DESC, doc_id', 20)},
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM (SELECT query_id, doc_id, rank FROM k UNION ALL SELECT query_id, doc_id, rank FROM d) GROUP BY 1, 2)
SELECT query_id, doc_id, score, best_rank, rank FROM {ranked('fused', 'score DESC, best_rank, doc_id', 10)}""")
def search_hybrid_filtered(t):
    within = R.matching_documents(t.documents, F.col("lang") == "en")
    return R.hybrid_search(queries_of(t), docs_of(t), query_vectors(t), vectors_of(t), 10, within=within)


LINES = "line AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_no, unnest(l) AS passage FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def lines_of(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "passage"))


@check(f"""WITH {BM25}, {LINES}, hit AS {ranked('bm25', 'score DESC, doc_id', 5)}
SELECT query_id, doc_id, rank, chunk_no, sha256(passage) AS passage FROM hit JOIN line USING (doc_id)""")
def search_passage_pairs(t):
    pairs = R.passage_pairs(K.bm25_top_k(queries_of(t), docs_of(t), 5), lines_of(t))
    return pairs.withColumn("passage", T.sha_hex("passage"))


OVERLAP = f"len(list_intersect(list_distinct({words('q.text')}), list_distinct({words('%s')})))"


@check(f"""WITH {BM25}, {LINES}, hit AS {ranked('bm25', 'score DESC, doc_id', 10)},
best AS (SELECT query_id, doc_id, max({OVERLAP % 'passage'}) AS score FROM hit JOIN queries q USING (query_id) JOIN line USING (doc_id) GROUP BY 1, 2),
joined AS (SELECT query_id, doc_id, rank AS original_rank, best.score FROM hit JOIN best USING (query_id, doc_id))
SELECT query_id, doc_id, original_rank, CAST(score AS DOUBLE) AS score, rank FROM {ranked('joined', 'score DESC, original_rank, doc_id', 10)}""")
def search_best_passage(t):
    """Rerank by the best passage, scored by word overlap."""
    hits = K.bm25_top_k(queries_of(t), docs_of(t), 10)
    pairs = R.passage_pairs(hits, lines_of(t)).join(queries_of(t), "query_id")
    overlap = F.size(F.array_intersect(F.array_distinct(T.words("text")), F.array_distinct(T.words("passage")))).cast("double")
    return R.rerank_by_best_passage(hits, pairs.select("query_id", "doc_id", overlap.alias("score")))


@check(f"""WITH {BM25}, hit AS {ranked('bm25', 'score DESC, doc_id', 10)},
scored AS (SELECT query_id, doc_id, CAST({OVERLAP % 'd.text'} AS DOUBLE) AS score FROM hit JOIN queries q USING (query_id) JOIN documents d USING (doc_id))
SELECT query_id, doc_id, score, rank FROM {ranked('scored', 'score DESC, doc_id', 10)}""")
def search_overlap_rerank(t):
    return R.rerank_by_overlap(K.bm25_top_k(queries_of(t), docs_of(t), 10), queries_of(t), docs_of(t))


@check(f"""WITH {BM25}, hit AS {ranked('bm25', 'score DESC, doc_id', 10)},
joined AS (SELECT query_id, doc_id, rank AS original_rank, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 10 AS DOUBLE) END AS score FROM hit JOIN documents USING (doc_id))
SELECT query_id, doc_id, original_rank, score, rank FROM {ranked('joined', 'score DESC NULLS LAST, original_rank, doc_id', 10)}""")
def search_score_rerank(t):
    hits = K.bm25_top_k(queries_of(t), docs_of(t), 10)
    scores = hits.select("query_id", "doc_id").join(t.documents.where("doc_id % 2 = 0"), "doc_id")
    return R.rerank_by_score(hits, scores.select("query_id", "doc_id", (F.col("n_chars") % 10).cast("double").alias("score")))


@check("""WITH asked AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS doc_id FROM lineitem WHERE l_quantity > 2),
got AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, count(*) AS n FROM lineitem WHERE l_quantity < 49 GROUP BY 1, 2)
SELECT query_id, doc_id, CASE WHEN a.query_id IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem
FROM (SELECT *, 1 AS one FROM asked) a FULL JOIN got g USING (query_id, doc_id) WHERE one IS NULL OR n IS NULL OR n > 1""".replace(
    "a.query_id IS NULL", "one IS NULL"))
def search_rerank_mismatches(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), "l_quantity")
    return R.rerank_mismatches(rows.where("l_quantity > 2").select("query_id", "doc_id").distinct(), rows.where("l_quantity < 49"))


SEARCH_DOCUMENTS = f"""{JOBS}, {JOB_SKILLS}, {SKILLS}, {COMPANIES},
names AS (SELECT DISTINCT job_id, requirement_type, canonical_name FROM job_skills JOIN skills s ON s.id = skill_id),
lists AS (SELECT job_id, string_agg(canonical_name, ', ' ORDER BY lower(canonical_name), canonical_name) FILTER (requirement_type = 'required') AS r,
  string_agg(canonical_name, ', ' ORDER BY lower(canonical_name), canonical_name) FILTER (requirement_type = 'preferred') AS p FROM names GROUP BY job_id),
search_documents AS (SELECT j.id AS job_id, c.name AS company, 'Title: ' || title || chr(10) || 'Location: ' || coalesce(location, 'Not specified') || chr(10) || 'Employment type: ' || coalesce(employment_type, 'Not specified')
  || chr(10) || 'Required skills: ' || coalesce(r, 'Not specified') || chr(10) || 'Preferred skills: ' || coalesce(p, 'Not specified') || chr(10) || 'Description: ' || description AS text
  FROM jobs j LEFT JOIN lists ON job_id = j.id LEFT JOIN companies c ON c.id = j.company_id)"""


def search_documents_of(t):
    jobs = t.jobs.withColumn("content_hash", F.sha2("description", 256))
    return S.search_documents(jobs, t.companies, t.job_skills, t.skills)


@check(f"WITH {SEARCH_DOCUMENTS} SELECT job_id, company, text, sha256(text) AS document_hash FROM search_documents")
def index_search_documents(t):
    return search_documents_of(t).select("job_id", "company", "text", "document_hash")


INDEX = """docs AS (SELECT doc_id AS job_id, sha256(text) AS h FROM documents),
stored AS (SELECT doc_id + 100 AS job_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE (SELECT h FROM docs o WHERE o.job_id = d.doc_id + 100) END AS old FROM documents d)"""


def index_sides(t):
    docs = t.documents.select(F.col("doc_id").alias("job_id"), "text", T.sha_hex("text").alias("document_hash"), "lang")
    shifted = t.documents.select((F.col("doc_id") + 100).alias("job_id"), T.sha_hex("text").alias("_other"), (F.col("doc_id") % 3 == 0).alias("_changed"))
    same = docs.select("job_id", F.col("document_hash").alias("_own"))
    stored = shifted.join(same, "job_id", "left").select(
        "job_id", F.when(F.col("_changed"), F.col("_other")).otherwise(F.col("_own")).alias("document_hash"), F.lit("xx").alias("lang"),
        F.array(F.col("job_id").cast("double")).alias("embedding"),
    )
    return docs, stored


STATUS = "CASE WHEN h IS NULL THEN 'stale' WHEN s.job_id IS NULL THEN 'new' WHEN old <> h THEN 'changed' ELSE 'unchanged' END"


@check(f"WITH {INDEX} SELECT coalesce(d.job_id, s.job_id) AS job_id, coalesce(h, old) AS document_hash, {STATUS.replace('s.job_id IS NULL', 's.job_id IS NULL OR old IS NULL')} AS status FROM docs d FULL JOIN stored s ON s.job_id = d.job_id")
def index_incremental_plan(t):
    return S.index_plan(*index_sides(t))


@check(f"""WITH {INDEX}, p AS (SELECT {STATUS} AS status FROM docs d FULL JOIN stored s ON s.job_id = d.job_id)
SELECT count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (status = 'stale') AS deleted, count(*) FILTER (status = 'unchanged') AS skipped FROM p""")
def index_incremental_counts(t):
    return S.index_counts(S.index_plan(*index_sides(t)))


# The word groups of the four-dimensional demonstration embedder.
GROUPS = (("en", "the", "is"), ("de", "la", "es"), ("un", "que", "tion"), ("and", "with", "zzz"))


def embedder():
    """Counts how many words of each group a text contains; all zeros become halves."""
    groups = GROUPS

    def embed(rows):
        import pandas as pd

        lowered = [text.lower() for text in rows["text"]]
        found = [[float(sum(w in text for w in group)) for group in groups] for text in lowered]
        return pd.DataFrame({"embedding": [v if any(v) else [0.5] * len(groups) for v in found]})

    return embed


EMBED = "[" + ", ".join("CAST(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in g) + " AS DOUBLE)" for g in GROUPS) + "]"
EMBEDDED = f"CASE WHEN list_sum({EMBED}) = 0 THEN [0.5::DOUBLE, 0.5, 0.5, 0.5] ELSE {EMBED} END"


@check(f"SELECT doc_id, {EMBEDDED} AS embedding FROM documents")
def inference_embed(t):
    return I.infer(docs_of(t), embedder, "embedding array<double>").select("doc_id", "embedding")


@check("SELECT doc_id, CASE WHEN NOT contains(text, 'idiot') THEN length(text) END AS chars FROM documents")
def inference_failure_isolation(t):
    """A model that fails on some texts; only those rows stay without an answer."""

    def make():
        def model(rows):
            import pandas as pd

            if rows["text"].str.contains("idiot", regex=False).any():
                raise ValueError("refused")
            return pd.DataFrame({"chars": rows["text"].str.len()})

        return model

    return I.infer(docs_of(t), make, "chars bigint", batch_size=8, attempts=1).select("doc_id", "chars")


@check("""WITH once AS (SELECT l_orderkey AS batch, l_partkey AS item, any_value(l_quantity) AS answer FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT l_orderkey AS batch, l_partkey AS item, answer FROM lineitem LEFT JOIN once ON batch = l_orderkey AND item = l_partkey""")
def inference_reconcile(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("answer"))
    return I.reconcile(rows.select("batch", "item").distinct(), rows.where("answer > 10"))


@check("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def inference_remaining(t):
    return I.remaining(t.documents.select("doc_id"), t.labels, "doc_id")


@check(f"""WITH {INDEX} SELECT doc_id AS job_id, sha256(text) AS document_hash, {EMBEDDED} AS embedding FROM documents d JOIN docs ON docs.job_id = doc_id LEFT JOIN stored s ON s.job_id = doc_id WHERE s.job_id IS NULL OR old <> h
UNION ALL SELECT d.job_id, old, [CAST(d.job_id AS DOUBLE)] FROM docs d JOIN stored s ON s.job_id = d.job_id AND old = h""")
def index_update(t):
    docs, stored = index_sides(t)
    return S.update_index(docs, stored.drop("lang"), lambda df: I.infer(df, embedder, "embedding array<double>"))


@check(f"""WITH {INDEX} SELECT s.job_id, coalesce(h, old) AS document_hash, CASE WHEN h IS NULL THEN 'xx' ELSE lang END AS lang, [CAST(s.job_id AS DOUBLE)] AS embedding
FROM stored s LEFT JOIN docs d ON d.job_id = s.job_id LEFT JOIN documents ON doc_id = s.job_id""")
def index_refresh_payloads(t):
    return S.refresh_payloads(*index_sides(t))


@check("SELECT vec_id AS job_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0")
def index_upsert(t):
    rows = t.embeddings.select(F.col("vec_id").alias("job_id"), "label")
    return S.upsert(rows, rows.where("job_id % 3 = 0").withColumn("label", F.col("label") + 100))


@check("SELECT doc_id AS job_id, sha256(text) AS document_hash FROM documents")
def index_scan(t):
    """Ids and hashes of an index that was written before."""
    folder = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    write_version(index_sides(t)[0], folder, 1)
    return S.stored_hashes(read_version(t.spark, folder, 1))


@check("SELECT doc_id, length(text) AS chars FROM documents")
def inference_saved_batches(t):
    """Answers for all documents, saved in four batches of which the second call finds two thirds done."""
    folder = f"{shared_folder(t.spark)}/answers-{uuid.uuid4().hex}"
    answer = lambda df: df.select("doc_id", F.length("text").cast("long").alias("chars"))
    I.infer_saved(docs_of(t).where("doc_id % 3 <> 0"), answer, folder, "doc_id", 4)
    return I.infer_saved(docs_of(t), answer, folder, "doc_id", 4)


@check()
def search_passages(t):
    """Passages of every document with a header line, as a reranker would read them."""
    headed = t.documents.select("doc_id", F.concat(F.lit("Title: "), "source", F.lit(S.DESCRIPTION), F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return S.passages(headed, S.chunks(max_chunks=None))


# DuckDB's expressions have no lookbehind, so the end of a sentence is marked and then split at.
@check(r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS sentences
FROM documents""")
def text_sentences(t):
    return t.documents.select("doc_id", F.size(T.sentences("text")).alias("sentences"))


RUNS = f"""{BM25}, {DENSE}, k AS {ranked('bm25', 'score DESC, doc_id', 10)}, d AS {ranked('pairs', 'score DESC, doc_id', 10)},
runs AS (SELECT query_id, 'bm25' AS method, doc_id, rank FROM k UNION ALL SELECT query_id, 'dense', doc_id, rank FROM d)"""


def runs_of(t, k: int = 10):
    keyword = K.bm25_top_k(queries_of(t), docs_of(t), k).select("query_id", F.lit("bm25").alias("method"), "doc_id", "rank")
    dense = D.dense_top_k(query_vectors(t), vectors_of(t), k).select("query_id", F.lit("dense").alias("method"), "doc_id", "rank")
    return keyword.unionByName(dense)


@check(f"WITH {RUNS} SELECT DISTINCT query_id, doc_id FROM runs")
def judge_pool(t):
    return E.candidate_pool(runs_of(t))


CACHE = "cache AS (SELECT query_id, doc_id FROM runs WHERE (query_id + doc_id) % 3 = 0)"


def cache_of(runs):
    judged = runs.where((F.col("query_id") + F.col("doc_id")) % 3 == 0).select("query_id", "doc_id").distinct()
    return judged.withColumn("prompt_version", F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1"))


@check(f"WITH {RUNS} SELECT DISTINCT query_id, doc_id FROM runs WHERE NOT ((query_id + doc_id) % 3 = 0 AND doc_id % 2 = 0)")
def judge_pending(t):
    runs = runs_of(t)
    return E.pending_pairs(E.candidate_pool(runs), cache_of(runs), "v2")


PENDING = "pending AS (SELECT DISTINCT query_id, doc_id FROM runs WHERE NOT ((query_id + doc_id) % 3 = 0 AND doc_id % 2 = 0))"


@check(f"WITH {RUNS}, {PENDING} SELECT CAST(sum(n) AS BIGINT) AS calls FROM (SELECT ceil(count(*) / 4.0) AS n FROM pending GROUP BY query_id)")
def judge_planned_calls(t):
    runs = runs_of(t)
    return E.planned_batches(E.pending_pairs(E.candidate_pool(runs), cache_of(runs), "v2"), 4)


@check("""WITH sized AS (SELECT l_orderkey % 500 AS query_id, l_partkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_partkey) - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey % 500) AS size FROM (SELECT DISTINCT l_orderkey % 500 AS l_orderkey, l_partkey FROM lineitem)),
b AS (SELECT *, CAST(ceil(size / 7.0) AS BIGINT) AS n FROM sized),
c AS (SELECT *, size // n AS base, size % n AS extra FROM b)
SELECT query_id, doc_id, 1 + CASE WHEN i < extra * (base + 1) THEN i // (base + 1) ELSE extra + (i - extra * (base + 1)) // base END AS batch FROM c""")
def judge_even_batches(t):
    pairs = t.lineitem.select((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_partkey").alias("doc_id")).distinct()
    return E.judge_batches(pairs, 7, block_width=256).select("query_id", "doc_id", "batch")

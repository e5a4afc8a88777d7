"""Registered queries of the training-data operators, each over its whole table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiregrain.llm import chat, exact, lines, merkle, negatives, packing, pieces, pii, search, sharding, simhash, sitetree, toxicity
from hiregrain.llm.common import lower_ascii, whole

SHARDS = 24
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the package is there on the driver and on every executor."""
    from public_tokenizers import path

    return str(path(name))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, folder, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_cell").alias("cell"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoding_report(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary(PIECE_BPE))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), words_per_shingle=4, max_bits=4)


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(whole("text"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted", "n_matches")


def op6_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", F.sha2(lower_ascii(whole("text")), 256).alias("text_sha256"))
    return exact.exact_groups(docs, carry=["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), vocabulary(BYTE_BPE))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    roles = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(roles), vocabulary(BYTE_BPE)))


def op10_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = merkle.document_manifest(_table(spark, folder, "documents"), checksum % 3 == 0)
    return made.audit("doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_pages(spark: SparkSession, folder: str) -> DataFrame:
    return sitetree.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hilbert, op2_sentencepiece, op3_simhash, op4_lines, op5_toxicity, op6_exact, op7_packing, op8_pii, op9_chat, op10_search, op11_negatives, op12_merkle, op13_pages)
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_TREE_LEVELS = 9  # of the SQL's trees: up to 8^9 rows a language


def _merkle_sql() -> str:
    """The manifest level by level: a tree's nodes at height h, each leaf's siblings there, and its folded hash."""
    piece = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
    leaf = " || ".join(piece.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{0}"))
    steps, height = [], 0
    for tree, (source, group) in {"l": ("(SELECT lang AS g, position AS i, node, n FROM placed)", "g"), "r": ("(SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, node, count(*) OVER () AS n, g AS lang FROM subroots)", "g")}.items():
        steps.append(f"{tree}0 AS (SELECT * FROM {source})")
        for height in range(_TREE_LEVELS):
            steps.append(
                f"{tree}{height + 1} AS (SELECT g, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node, (any_value(n) + 7) // 8 AS n FROM {tree}{height} WHERE n > 1 GROUP BY g, i // 8)"
            )
        every = " UNION ALL ".join(f"SELECT {h} AS h, g, i, node, n FROM {tree}{h}" for h in range(_TREE_LEVELS + 1))
        steps.append(f"{tree}all AS ({every})")
        steps.append(f"{tree}runs AS (SELECT h, g, i // 8 AS run, list(node ORDER BY i) AS nodes FROM {tree}all WHERE n > 1 GROUP BY ALL)")
        if tree == "l":
            steps.append("subroots AS (SELECT g, node FROM lall WHERE n = 1)")
    other = "list_filter(nodes, lambda x, k: k <> {0} + 1)"
    folds = []
    for tree, before in (("l", "placed0"), ("r", "placed1")):
        key = "p.lang" if tree == "l" else "0"
        done = before
        for h in range(_TREE_LEVELS):
            place = f"((p.spot // {8**h}) % 8)"
            folds.append(
                f"{tree}f{h} AS (SELECT p.* EXCLUDE (proof, folded), p.proof || coalesce(array_to_string({other.format(place)}, ''), '') AS proof, "
                f"CASE WHEN nodes IS NULL THEN p.folded ELSE sha256(array_to_string(list_transform(nodes, lambda x, k: CASE WHEN k = {place} + 1 THEN p.folded ELSE x END), '')) END AS folded "
                f"FROM {done} p LEFT JOIN {tree}runs s ON s.h = {h} AND s.g IS NOT DISTINCT FROM {key} AND s.run = p.spot // {8 ** (h + 1)})"
            )
            done = f"{tree}f{h}"
        if tree == "l":
            folds.append(f"placed1 AS (SELECT p.* EXCLUDE (spot), r.i AS spot, r.node AS subroot FROM {done} p JOIN r0 r ON r.lang IS NOT DISTINCT FROM p.lang)")
    polynomial = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {0})"
    byte = polynomial.format("xor(c, CAST(ord(x) AS BIGINT))")
    checksum = f"xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, x: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"
    lowered = _LOWER.format("text")
    return f"""WITH leaves AS (SELECT doc_id, lang, sha256({leaf.format("text")}) AS node,
  CASE WHEN {checksum} % 3 = 0 THEN sha256({leaf.format(lowered)}) END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS position, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{", ".join(steps)},
root AS (SELECT node AS root FROM rall WHERE n = 1),
placed0 AS (SELECT doc_id, lang, node, position AS spot, '' AS proof, coalesce(tampered, node) AS folded FROM placed),
{", ".join(folds)}
SELECT doc_id, node AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {done}, root"""


ORACLES: dict[str, str] = {
    "op4_lines": f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS k FROM lines),
common AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op6_exact": f"""WITH folded AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY t)""",
    "op10_search": """WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM usable),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM parts q JOIN parts c USING (d)
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
QUALIFY rank <= 5""",
    "op11_negatives": """WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM usable),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(sum(a.x * c.x) AS BIGINT) AS score FROM parts a JOIN parts c USING (d)
  WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id GROUP BY ALL),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
  CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank FROM scores WHERE own = label QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives JOIN scores USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op12_merkle": _merkle_sql(),
}

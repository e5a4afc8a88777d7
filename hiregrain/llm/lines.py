"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash; lines of hashes over the threshold go, except
in the smallest document that holds them; the others are put together again by their position.

Defined results: a null or empty text is one empty line; a line repeated inside one document only is kept; repeated rows
with one id count as one document; a row without an id counts for nothing and keeps all its lines; extra columns stay, but for
ones with the names of the two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import WHITE, lower_ascii, whole
from hiregrain.session import materialize


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = 10, min_documents: int = 2) -> DataFrame:
    """``docs`` with the text cleaned, ``n_lines`` (before) and ``n_dropped``.

    Only keys of ``min_length`` code points or more, found in ``min_documents`` documents or more, lose lines. Lines travel as
    128-bit hashes with their position; the text is shuffled once, for the join that puts the kept lines together.
    """
    split = F.split(whole(text), "\n", -1)
    row = F.xxhash64(whole(text))  # tells rows with one id apart
    lines = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), row.alias("_row"), F.posexplode(F.transform(split, line_key)).alias("_pos", "_key"))
    lines = lines.where(F.char_length("_key") >= min_length).select("_id", "_row", "_pos", F.unhex(F.md5("_key")).alias("_hash"))
    common = lines.groupBy("_hash").agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_n"))
    # Written out, so that the join has an exchange of its own on either side and Spark can split a common line's partition.
    common = materialize(common.where(F.col("_n") >= min_documents).select("_hash", "_first"))
    dropped = lines.join(common, "_hash").where("_id > _first").groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
    # The input's columns travel inside one struct, where no name can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_column).alias("_id"), row.alias("_row"))
    out = keyed.join(dropped, ["_id", "_row"], "left").withColumn("_lines", F.split(F.coalesce(F.col("_doc").getField(text), F.lit("")), "\n", -1))
    n = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    clean = F.when(F.col("_drop").isNull(), F.col("_doc").getField(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    others = [F.col("_doc").getField(c).alias(c) if c != text else clean.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*others, n.cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))

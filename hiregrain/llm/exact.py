"""Exact deduplication by progressive refinement.

Rows are grouped by length, the rows of crowded lengths by a hash of their first characters, and only the rows still in
company have their whole content hashed. What decides who is still in company is a bitmap of fixed size, so no text is
shuffled at any step: a row that the bitmap lets through by chance merely costs one hash too many.

Defined results: a null text equals an empty one; texts are equal when identical after A-Z are lower-cased; of equal
texts the largest id stays (rows that repeat it stay together), a null id never beats another; extra columns are
carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import lower_ascii, whole
from hiregrain.session import materialize

PREFIX = 64
BITMAP_BITS = 23  # 1 MiB, whatever the input; more bits spare more hashes on a larger corpus
_WORD_BITS = 15  # bitmap_construct_agg packs this many bits (as a power of two) in one row


def _slot(keys: Sequence[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def _length(text: str) -> Column:
    return F.octet_length(whole(text))


def _head(text: str, prefix: int) -> Column:
    return F.xxhash64(lower_ascii(F.substring(whole(text), 1, prefix)))


def _bitmap(crowded: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """At most ``2**(bits - 15)`` rows of 4 KiB: one bit per slot that a crowded key falls in."""
    slot = _slot([F.col(k) for k in keys], bits)
    cells = crowded.select(F.shiftright(slot, _WORD_BITS).alias("_bucket"), slot.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).alias("_bit"))
    return cells.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def _in_bitmap(df: DataFrame, bitmap: DataFrame, keys: Sequence[Column], bits: int, name: str) -> DataFrame:
    """``df`` with a flag that is true for every row whose key is crowded, and for few others."""
    slot = _slot(keys, bits)
    with_slot = df.withColumn("_slot", slot).withColumn("_bucket", F.shiftright("_slot", _WORD_BITS))
    joined = with_slot.join(F.broadcast(bitmap), "_bucket", "left")  # fixed size: 2**bits / 8 bytes
    bit = F.col("_slot").bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_map")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = (), prefix: int = PREFIX, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per input row: the id, the carried columns, ``keep_id``, ``group_size`` and ``kept``."""
    signature = docs.select(_length(text).alias("_len"), _head(text, prefix).alias("_head"))
    counted = materialize(signature.groupBy("_len", "_head").agg(F.count("*").alias("_n")))  # a hot key is one row per task
    lengths = counted.groupBy("_len").agg(F.sum("_n").alias("_total")).where("_total > 1").select("_len")
    heads = counted.where("_n > 1").join(lengths, "_len", "left_semi")
    bitmap = _bitmap(heads, ["_len", "_head"], bits)
    carried = F.struct(*[F.col(f"`{c}`") for c in (id_column, *carry)]).alias("_row")  # no name can clash in there
    met = _in_bitmap(docs.select(carried, F.col(id_column).alias("_id"), F.col(text).alias("_text")), bitmap, [_length("_text"), _head("_text", prefix)], bits, "_met")
    full = F.when(F.col("_met"), F.unhex(F.sha2(lower_ascii(whole("_text")), 256)))
    rows = materialize(met.select("_row", "_id", full.alias("_full")))
    hashed, alone = rows.where("_full is not null"), rows.where("_full is null")  # the latter would all meet on null
    groups = hashed.groupBy("_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # Written out, so that the join has an exchange of its own on either side and Spark can split a large group's partition.
    out = hashed.join(materialize(groups), "_full", "left").unionByName(alone, allowMissingColumns=True)
    keep = F.coalesce("keep_id", "_id")
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in (id_column, *carry)], keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == keep, F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
    )

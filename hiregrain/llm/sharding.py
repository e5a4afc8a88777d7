"""Sharding by position on a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to ``bits`` bits each, the cell they span is numbered along a Hilbert curve, and
the rows, ordered by that number, are cut into runs. A run covers a compact region in every dimension at once, so the
per-shard ranges of :func:`shard_ranges` let a reader skip files whichever dimension it filters on.

Defined results: a null dimension lies at level 0; null ids come first in their cell; repeated rows get slots of their
own; an empty table gives no rows; more shards than rows leave shards empty; extra columns are carried along, but for ones
with the names of the three new columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536  # rows of the densest cell one task numbers, on average, at the least
COARSE_BITS = 8


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: digit and next state for ``state * 2**dims + label``.

    A state is the entry corner ``e`` and direction ``d`` of a sub-cube, numbered ``e * dims + d``.
    """
    size = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    digits, following = [], []
    for state in range(size * dims):
        entry, direction = divmod(state, dims)
        for label in range(size):
            code = turn(label ^ entry, dims - direction - 1)
            digit = code
            for shift in range(1, dims):
                digit ^= code >> shift
            corner = 0 if digit == 0 else ((digit - 1) // 2 * 2) ^ (((digit - 1) // 2 * 2) >> 1)
            step = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit)
            digits.append(digit)
            following.append((entry ^ turn(corner, direction + 1)) * dims + (direction + step + 1) % dims)
    return digits, following


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Number on the curve of the cell with these levels, each in ``[0, 2**bits)``."""
    dims = len(levels)
    digits, following = (F.lit(t) for t in curve_table(dims))

    def step(at: Column, bit: Column) -> Column:
        label = F.lit(0)
        for j, level in enumerate(levels):
            label = label + F.call_function("shiftright", level, bit).bitwiseAND(F.lit(1)) * F.lit(1 << j)
        place = (at["state"] * F.lit(1 << dims) + label).cast("int")
        return F.struct((at["index"] * F.lit(1 << dims) + F.get(digits, place)).cast("long").alias("index"), F.get(following, place).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


def name_level(name: str, bits: int) -> Column:
    """Level of a name (language, source, host): equal names share it, and a filter on a name knows its level."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(name)), 1, 4), 16, 10).cast("int") % (1 << bits), F.lit(0))


def size_level(size: Column, bits: int) -> Column:
    """Level of a size by its power of two, clipped to the highest level."""
    return F.coalesce(F.least(F.floor(F.log2(size + 1)).cast("int"), F.lit((1 << bits) - 1)), F.lit(0))


def range_level(value: Column, low: float | None, high: float | None, bits: int) -> Column:
    """Level of an ordered value within the table's range."""
    width = max(float((high or 0) - (low or 0)), 1.0)
    share = (value - F.lit(low or 0)) / F.lit(width)
    return F.coalesce(F.least(F.floor(share * (1 << bits)).cast("int"), F.lit((1 << bits) - 1)), F.lit(0))


def hilbert_shards(df: DataFrame, id_column: str, levels: Mapping[str, Column], size: str, shards: int, bits: int = 4, law: str = "rows") -> DataFrame:
    """Rows of ``df`` with ``_cell`` (number on the curve), ``shard`` and ``slot`` (gapless from 0 in the shard).

    ``law``: ``rows`` cuts runs whose row counts are at most one apart, ``bytes`` cuts runs of nearly equal total
    ``size``. No task sorts more than a block: a cell is split by the hash of the id as the table grows, blocks are
    only counted, and the running totals over the at most ``2**COARSE_BITS`` coarse cells are the only single task.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    n = df.count()
    parts = max(8, -(-n // BLOCK_ROWS))
    depth = max(0, bits * len(levels) - COARSE_BITS)
    names = [c for c in df.columns if c not in ("_cell", "shard", "slot")]
    keyed = df.select(  # the input's columns travel inside one struct, where no name can clash
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_in"), F.col(id_column).alias("_id"), F.coalesce(F.col(size), F.lit(0)).alias("_size"),
        hilbert_index(list(levels.values()), bits).alias("_cell"), F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int").alias("_part"),
    )
    weight = F.sum("_size")
    blocks = keyed.groupBy("_cell", "_part").agg(F.count("*").alias("_n"), weight.alias("_w")).withColumn("_coarse", F.shiftright("_cell", depth))

    def before(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = blocks.groupBy("_coarse").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))
    along = Window.orderBy("_coarse")  # at most 2**COARSE_BITS rows
    coarse = coarse.select("_coarse", before("_n", along).alias("_n0"), before("_w", along).alias("_w0"), F.sum("_w").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_coarse").orderBy("_cell", "_part")
    starts = blocks.withColumn("_n1", before("_n", inside)).withColumn("_w1", before("_w", inside)).join(F.broadcast(coarse), "_coarse")
    starts = starts.select("_cell", "_part", (F.col("_n0") + F.col("_n1")).alias("_n2"), (F.col("_w0") + F.col("_w1")).alias("_w2"), "_all")
    order = Window.partitionBy("_cell", "_part").orderBy("_id", "_size")
    placed = keyed.withColumn("_row", F.row_number().over(order) - 1)
    if law == "bytes":
        placed = placed.withColumn("_w3", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(starts, ["_cell", "_part"]).withColumn("_at", F.col("_n2") + F.col("_row"))
    count, total = F.lit(shards).cast("long"), F.lit(max(n, 1)).cast("long")
    if law == "rows":
        shard = F.expr(f"_at * {shards}L div {max(n, 1)}L")
        placed = placed.withColumn("shard", shard.cast("int"))
        placed = placed.withColumn("slot", F.col("_at") - F.call_function("ceil", F.col("shard") * total / count).cast("long"))
    else:
        at = F.coalesce(F.try_divide((F.col("_w2") + F.col("_w3")).cast("double") * shards, F.col("_all")), F.lit(0.0))
        placed = placed.withColumn("shard", F.least(F.floor(at).cast("int"), F.lit(shards - 1)))
        first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row per shard
        placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_at") - F.col("_first"))
    return placed.select("_in.*", "_cell", "shard", "slot")


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """What a reader needs to skip shards: rows, and the range of every column, per shard."""
    ranges = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ranges)


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder per shard, rows in curve order."""
    out = sharded.drop("_cell")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def document_levels(docs: DataFrame, bits: int = 4) -> dict[str, Column]:
    """The curve of the documents table: language, source, size and id range."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return {
        "lang": name_level("lang", bits), "source": name_level("source", bits),
        "size": size_level(F.col("size"), bits), "doc_id": range_level(F.col("doc_id"), low, high, bits),
    }


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents table in ``shards`` shards; texts only pass through their size and checksum."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return hilbert_shards(slim, "doc_id", document_levels(docs), "size", shards)

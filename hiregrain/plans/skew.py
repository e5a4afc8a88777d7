"""Plan shapes that stay balanced when one key holds a large share of all rows.

A window partitioned by such a key, or a list collected for it, would land in one task. The
helpers here pre-aggregate on the map side, cut a hot group into ordered blocks, or narrow an
order statistic down to a sliver of the group before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_GROUP = 10_000
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 5e-4


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order``; combined map-side, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[c for c in keys], "_first.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key with their 1-based rank.

    The rank filter lets Spark cut each map task to ``k`` rows per key before the shuffle, so the
    final window sees at most ``k`` rows per task even for a hot key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str = "position"
) -> DataFrame:
    """1-based position inside the group; ``block`` must not decrease along ``order``.

    Rows are numbered inside (key, block) and shifted by the size of the blocks before, so no task
    sorts a whole group.
    """
    blocked = df.withColumn("_block", block)
    local = blocked.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_size"))
        .select(*keys, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        local.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_block", "_local", "_before")
    )


def with_halo(df: DataFrame, position: Column, width: float, reach: float) -> DataFrame:
    """Cut an ordered axis into blocks and copy the last ``reach`` of each block into the next.

    Adds ``_block`` and ``_copy``. A window over (key, ``_block``) then sees every row that is at
    most ``reach`` back; rows flagged ``_copy`` only serve as context and are dropped afterwards.
    """
    if reach > width:
        raise ValueError("a block must be at least as wide as the reach of the window")
    block = F.floor(position / F.lit(width))
    own = F.struct(block.alias("_block"), F.lit(False).alias("_copy"))
    copy = F.struct((block + 1).alias("_block"), F.lit(True).alias("_copy"))
    near_end = position - block * F.lit(width) >= F.lit(width - reach)
    return df.withColumn("_at", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own)))).select(
        *df.columns, "_at.*"
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    indexes: Callable[[Column], Sequence[Column]],
    finish: Callable[[Sequence[Column]], Column],
    name: str,
) -> DataFrame:
    """Exact order statistics per group without sorting the group.

    A quantile sketch (bounded state, merged map-side) brackets the wanted position, rows below the
    bracket are only counted, and the few inside it are counted per distinct value and walked in
    order. ``indexes`` maps the group size to 0-based positions near ``share``; the sketch margin
    exceeds its guaranteed error, so the positions always fall inside the bracket.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    shares = [max(0.0, share - SKETCH_MARGIN), min(1.0, share + SKETCH_MARGIN)]
    pivots = F.percentile_approx("_v", shares, SKETCH_ACCURACY)
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), pivots.alias("_p")
    )
    small = F.col("_n") <= SMALL_GROUP
    bracket = sketch.select(
        *keys,
        "_n",
        F.when(small, F.col("_min")).otherwise(F.col("_p")[0]).alias("_lo"),
        F.when(small, F.col("_max")).otherwise(F.col("_p")[1]).alias("_hi"),
    )
    if keys:
        bracketed = rows.join(bracket, list(keys))
    else:
        bracketed = rows.withColumn("_b", bracket.select(F.struct("*")).scalar()).select("_v", "_b.*")
    # Values below the bracket collapse into one entry that only carries their count.
    counted = (
        bracketed.where(F.col("_v") <= F.col("_hi"))
        .groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    ordered = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    cumulated = counted.withColumn(
        "_cum", F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    wanted = list(indexes(F.col("_n")))
    picked = cumulated.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_cum") > index, F.col("_v"))).alias(f"_i{i}") for i, index in enumerate(wanted)]
    )
    return picked.select(*keys, finish([F.col(f"_i{i}") for i in range(len(wanted))]).alias(name))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Nearest-rank percentile: position ``round((n - 1) * share)``, halves to even."""
    index = lambda n: [F.bround((n - 1) * F.lit(share)).cast("long")]
    return order_statistics(df, keys, value, share, index, lambda v: v[0], name)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median; the mean of the two middle values for an even count."""
    index = lambda n: [F.floor((n - 1) / 2), F.ceil((n - 1) / 2)]
    return order_statistics(df, keys, value, 0.5, index, lambda v: (v[0] + v[1]) / 2, name)


def fixed_batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, size: int) -> DataFrame:
    """Number the rows of every group in batches of ``size``, the last one shorter; ``block`` as in :func:`position_in_group`."""
    if size < 1:
        raise ValueError("the batch size must be at least 1")
    placed = position_in_group(df, keys, order, block, "_position")
    return placed.withColumn("batch", (F.floor((F.col("_position") - 1) / size) + 1).cast("long")).drop("_position")


def even_batches(df: DataFrame, keys: Sequence[str], position: str, size: str, limit: int) -> DataFrame:
    """Fewest batches of at most ``limit`` rows whose sizes differ by one at most, larger first.

    ``position`` is the 1-based position in the group and ``size`` the group's row count.
    """
    if limit < 1:
        raise ValueError("the batch size must be at least 1")
    index, rows = F.col(position) - 1, F.col(size)
    batches = F.ceil(rows / limit)
    base = F.floor(rows / batches)
    extra = rows - base * batches
    in_larger = index < extra * (base + 1)
    number = F.when(in_larger, F.floor(index / (base + 1))).otherwise(
        extra + F.floor((index - extra * (base + 1)) / base)
    )
    return df.withColumn("batch", (number + 1).cast("long"))

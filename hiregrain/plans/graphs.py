"""Iterative plans on graphs. Every round is a few joins, then the lineage is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.session import materialize, written

ROUNDS = 4  # of the two-key pass, before what is left is walked group by group


def components(members: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Connected components of nodes that share keys: ``(node, component)``, the smallest node id.

    Groups are contracted: every group adopts the first group seen over its keys, pointers are
    followed a few steps, and only keys that still touch two groups stay for the next round. First is
    by a hash of the label, so that even along a chain of ascending ids a good share of the groups
    goes in every round. Nodes are never paired with each other: a key with many nodes costs one
    pre-aggregated minimum.
    """
    label = F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("n"))
    links = members.select(label.alias("label"), F.col(key).alias("key")).distinct()
    pairs = written(links)
    labels = pairs.select(F.col("label").alias("node"), "label").distinct()
    while True:
        shared = pairs.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        open_pairs = written(pairs.join(shared.select("key", "low"), "key"))
        if open_pairs.isEmpty():
            smallest = written(labels.groupBy("label").agg(F.min("node.n").alias("_smallest")))
            return labels.join(smallest, "label").select(F.col("node.n").alias(node), F.col("_smallest").alias("component"))
        up = written(open_pairs.groupBy("label").agg(F.min("low").alias("up")))
        for _ in range(2):
            further = up.select(F.col("label").alias("up"), F.col("up").alias("next"))
            up = up.join(further, "up", "left").select("label", F.coalesce("next", "up").alias("up"))
        up = written(up)
        labels = written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        pairs = open_pairs.join(up, "label").select(F.col("up").alias("label"), "key").distinct()


def keep_first_on_both(rows: DataFrame, order: str, first: str, second: str, rounds: int = ROUNDS) -> DataFrame:
    """Ids kept by a pass in ``order`` that drops a row sharing either key with an earlier kept row.

    A dropped row claims no key, so two independent first-per-key passes would drop too much. Only the earliest row of
    each key pair can be kept, so copies are folded first. A row is kept once it is the earliest remaining row for both of
    its keys, and rows sharing a key with it leave; a few such rounds settle nearly everything. What is left are long
    chains of rows that hang on each other: their connected groups are dealt out whole and walked in order, a task holding
    the keys that one group has claimed. A null second key claims nothing.
    """
    left = materialize(
        rows.groupBy(F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.min(order).alias("_id"))
    )
    kept = []
    for _ in range(rounds):
        best_a = left.groupBy("_a").agg(F.min("_id").alias("_ma"))
        best_b = left.where("_b is not null").groupBy("_b").agg(F.min("_id").alias("_mb"))
        ranked = left.join(best_a, "_a").join(best_b, "_b", "left")
        won = materialize(
            ranked.where("_id = _ma and (_b is null or _id = _mb)").select("_id", "_a", "_b")
        )
        kept.append(won.select(F.col("_id").alias(order)))
        left = materialize(
            left.join(won.select("_a"), "_a", "left_anti")
            .join(won.where("_b is not null").select("_b").distinct(), "_b", "left_anti")
            .select("_a", "_b", "_id")
        )
        if left.isEmpty():
            break
    else:
        kept.append(_walk_groups(left).select(F.col("_id").cast(rows.schema[order].dataType).alias(order)))
    result = kept[0]
    for part in kept[1:]:
        result = result.unionByName(part)
    return result


def _walk_groups(left: DataFrame) -> DataFrame:
    """Ids kept of the rows ``(_a, _b, _id)``, group by group of rows connected by keys."""
    keys = F.array(F.concat(F.lit("a"), F.col("_a").cast("string")), F.concat(F.lit("b"), F.col("_b").cast("string")))
    members = left.select(F.col("_id").alias("node"), F.explode(keys).alias("key")).where("key is not null")
    placed = left.join(components(members).select(F.col("node").alias("_id"), "component"), "_id")
    # Only hashes of keys travel; two of them make a chance meeting of different keys as good as impossible.
    mark = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 32)).alias(c)
    ordered = placed.select("component", "_id", mark("_a"), mark("_b")).repartition("component").sortWithinPartitions("component", "_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, claimed = None, set()
        for batch in batches:
            ids = []
            for component, number, a, b in zip(batch["component"], batch["_id"], batch["_a"], batch["_b"], strict=True):
                if component != group:
                    group, claimed = component, set()
                own = {("a", a)} | ({("b", b)} if b is not None else set())
                if claimed.isdisjoint(own):
                    claimed |= own
                    ids.append(number)
            yield pd.DataFrame({"_id": ids})

    return ordered.mapInPandas(walk, f"_id {left.schema['_id'].dataType.simpleString()}")

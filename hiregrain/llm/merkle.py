"""A Merkle manifest of a dataset as a persistent tree with path copying.

Every row is a leaf, the rows of a language form one tree, and the languages' roots form a last one. All trees are
eight-way: while several nodes remain, every eight consecutive ones become their hash.

A tree is worked on in aligned blocks of :data:`SPAN` nodes, which are whole subtrees, so a block is one task of fixed size
whatever the language's share. The tops of all blocks are the nodes of a smaller tree, which is climbed in the same way until
one node is left. Each block then learns the path above its top, and no task ever sees more than a block and one path.

A tampered leaf makes a new version of the tree. Versions are persistent: one shares every node that it doesn't change
with the original and copies only the ancestors of its leaf, first those inside its aligned block, then, with the block's path,
those of the upper levels. The last copy is the version's root.

Defined results: hashes are lowercase hex SHA-256 over hex text. Rows with a null language form a language of their own, ordered
first. A row without an id is a leaf like any other, ordered first, and is never tampered with by the id's checksum. Rows that
repeat an id are ordered by their leaf. Empty tables have no root and give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiregrain.llm.common import lower_ascii
from hiregrain.session import materialize

FAN = 8
LEVELS = 4
SPAN = FAN**LEVELS  # nodes of a block
# What lies above a node: per level its place in its run, and the run's other members in order.
PATH = "array<struct<place: int, others: array<string>>>"
Path = list[tuple[int, list[str]]]


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """The leaf over ``columns``: ``-`` for null, else UTF-8 byte count, ``:``, value."""

    def piece(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[piece(c) for c in columns]), 256)


def document_leaf(text: Column) -> Column:
    """The leaf of a ``documents`` row, with ``text`` in the place of its own."""
    return leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])


def climb(nodes: list[str], height: int) -> list[list[str]]:
    """All levels above ``nodes``, themselves included, ``height`` levels up."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def path_of(levels: list[list[str]], at: int) -> Path:
    """Places and siblings on the way up from node ``at`` of the lowest level."""
    path = []
    for level in levels[:-1]:
        start = at // FAN * FAN
        path.append((at - start, level[start:at] + level[at + 1 : start + FAN]))
        at //= FAN
    return path


def copied(node: str, path: Path) -> list[str]:
    """The ancestors that a version with ``node`` in the original's place holds copies of, lowest first."""
    copies = []
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
        copies.append(node)
    return copies


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``position`` (from 0) of every row in its group and the group's size ``n``, without sorting a group in one task.

    Rows are sorted over ranges of group and order together; a task counts its own rows of each group, and the
    counts of the tasks before shift them. Equal rows are told apart by a number given to them here.
    """
    told = materialize(df.withColumn("_tie", F.monotonically_increasing_id()))
    placed = told.repartitionByRange(F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "_tie").sortWithinPartitions(
        F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "_tie"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, object()
        for batch in batches:
            here = []
            for key in batch.column(group).to_pylist():
                seen, last = (seen + 1, last) if key == last else (0, key)
                here.append(seen)
            yield batch.append_column("_part", pa.array([part] * len(here), pa.int32())).append_column("_here", pa.array(here, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    local = materialize(placed.mapInArrow(count, f"{fields}, _part int, _here long"))
    before = Window.partitionBy("_key").orderBy("_part")
    shifts = (
        local.groupBy(F.col(group).alias("_key"), "_part").agg(F.count("*").alias("_size"))
        .select("_key", F.col("_part").alias("_in"), (F.sum("_size").over(before) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy("_key")).alias("n"))
    )
    joined = local.join(shifts, (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_key")))
    return joined.withColumn("position", F.col("_before") + F.col("_here")).drop("_key", "_in", "_part", "_here", "_before", "_tie")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / SPAN).cast("long"))


def _block_top(group: str, table: pa.Table) -> pa.Table:
    """The top of one aligned block and the next tree's size."""
    table = table.sort_by([("position", "ascending")])
    n = table.column("n")[0].as_py()
    levels = climb(table.column("node").to_pylist(), min(height(n), LEVELS))
    top = {group: table.column(group)[:1], "block": table.column("block")[:1], "n": pa.array([-(-n // SPAN)], pa.int64()), "node": pa.array(levels[-1])}
    return pa.table(top)


def tops(nodes: DataFrame, group: str) -> DataFrame:
    """One row per aligned block: its top is node ``position`` of the next, smaller tree of ``n`` nodes."""
    kind = dict(nodes.dtypes)[group]
    made = _blocked(nodes.select(group, "position", "n", "node")).groupBy(group, "block").applyInArrow(lambda t: _block_top(group, t), f"`{group}` {kind}, block long, n long, node string")
    return made.withColumnRenamed("block", "position")


def root_paths(nodes: DataFrame, group: str) -> DataFrame:
    """``group``, ``position``, ``path`` from every node of a tree to its root, and the ``root``.

    A tree of one node is its own root. Larger ones are climbed block by block, and every block's path continues in the
    tree of the tops; each round makes the trees :data:`SPAN` times smaller.
    """
    if nodes.where("n > 1").isEmpty():
        return nodes.select(group, "position", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    above = root_paths(materialize(tops(nodes, group)), group)
    kind = dict(nodes.dtypes)[group]

    def work(block: pa.Table, upper: pa.Table) -> pa.Table:
        return pa.table(_paths(block, upper, group), schema=pa.schema([(group, block.schema.field(group).type), ("position", pa.int64()), ("path", _path_type()), ("root", pa.string())]))

    return _with_upper(nodes, above, group).applyInArrow(work, f"`{group}` {kind}, position long, path {PATH}, root string")


def _path_type() -> pa.DataType:
    return pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def _with_upper(nodes: DataFrame, above: DataFrame, group: str):
    """Every aligned block next to the one row that lies above it."""
    upper = above.select(*[F.col(c).alias("block" if c == "position" else c) for c in above.columns])
    return _blocked(nodes).groupBy(group, "block").cogroup(upper.groupBy(group, "block"))


def _opened(block: pa.Table, upper: pa.Table) -> tuple[pa.Table, list[list[str]], Path, str]:
    """A block in order, its levels, and the path and root above it."""
    block = block.sort_by([("position", "ascending")])
    levels = climb(block.column("node").to_pylist(), min(height(block.column("n")[0].as_py()), LEVELS))
    path = [(step["place"], step["others"]) for step in upper.column("path")[0].as_py()]
    return block, levels, path, upper.column("root")[0].as_py()


def _paths(block: pa.Table, upper: pa.Table, group: str) -> dict[str, list]:
    block, levels, rest, root = _opened(block, upper)
    full = [[{"place": p, "others": o} for p, o in path_of(levels, at) + rest] for at in range(block.num_rows)]
    return {group: block.column(group).to_pylist(), "position": block.column("position").to_pylist(), "path": full, "root": [root] * block.num_rows}


@dataclass
class Manifest:
    """The tree: ``leaves`` (every row with its ``node``, ``tampered`` leaf, ``position`` and language size ``n``) and ``above``.

    ``above`` holds one row per block of leaves: the ``path`` from its top to the root, the language's ``subroot`` and the ``root``.
    """

    leaves: DataFrame
    above: DataFrame
    group: str

    def _map_blocks(self, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return _with_upper(self.leaves, self.above, self.group).applyInArrow(work, schema)

    def nodes(self) -> DataFrame:
        """The original's nodes inside the blocks: language, ``level`` (leaves: 0), ``at`` (from 0) and ``node``."""
        group, kind = self.group, dict(self.leaves.dtypes)[self.group]

        def work(block: pa.Table, upper: pa.Table) -> pa.Table:
            block, levels, _, _ = _opened(block, upper)
            first = block.column("position")[0].as_py()
            rows = [(level, first // FAN**level + i, node) for level, nodes in enumerate(levels) for i, node in enumerate(nodes)]
            key = pa.array([block.column(group)[0].as_py()] * len(rows), block.schema.field(group).type)
            return pa.table({group: key, "level": pa.array([r[0] for r in rows], pa.int32()), "at": pa.array([r[1] for r in rows], pa.int64()), "node": [r[2] for r in rows]})

        return self._map_blocks(work, f"`{group}` {kind}, level int, at long, node string")

    def versions(self, key: str) -> DataFrame:
        """The copied nodes of every version: ``key`` of the tampered row, ``step`` (leaf: 0, the root last) and ``node``.

        All other nodes are the original's. A row without a ``tampered`` leaf makes no version.
        """
        kind = dict(self.leaves.dtypes)[key]

        def work(block: pa.Table, upper: pa.Table) -> pa.Table:
            block, levels, rest, _ = _opened(block, upper)
            rows = []
            for at, (name, changed) in enumerate(zip(block.column(key).to_pylist(), block.column("tampered").to_pylist())):
                if changed is not None:
                    rows += [(name, step, node) for step, node in enumerate([changed, *copied(changed, path_of(levels, at) + rest)])]
            return pa.table({key: pa.array([r[0] for r in rows], block.schema.field(key).type), "step": pa.array([r[1] for r in rows], pa.int32()), "node": pa.array([r[2] for r in rows], pa.string())})

        return self._map_blocks(work, f"`{key}` {kind}, step int, node string")

    def audit(self, key: str) -> DataFrame:
        """Per row its ``leaf``, ``subroot``, ``root``, its proof's digest, and the root of its version (the refolded one if untampered)."""
        kind = dict(self.leaves.dtypes)[key]

        def work(block: pa.Table, upper: pa.Table) -> pa.Table:
            block, levels, rest, root = _opened(block, upper)
            beyond = [h for _, others in rest for h in others]
            proofs, folded = [], []
            original = block.column("node").to_pylist()
            for at, (node, changed) in enumerate(zip(original, block.column("tampered").to_pylist())):
                inside = path_of(levels, at)
                proofs.append(digest([*(h for _, others in inside for h in others), *beyond]))
                node = node if changed is None else changed
                folded.append([node, *copied(node, inside + rest)][-1])
            same = {c: upper.column(c)[0].as_py() for c in ("subroot", "root")}
            return pa.table({key: block.column(key), "leaf": original, **{c: [v] * len(original) for c, v in same.items()}, "proof_sha256": proofs, "folded_root": folded})

        return self._map_blocks(work, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(rows: DataFrame, group: str, order: list[str]) -> Manifest:
    """The tree over ``rows``, which hold their leaf as ``node`` and a changed one, or null, as ``tampered``."""
    leaves = numbered(rows, group, [*order, "node"])
    inner = root_paths(materialize(tops(leaves, group)), group).withColumnRenamed("root", "subroot")
    languages = numbered(inner.where("position = 0").select(group, F.col("subroot").alias("node"), F.lit(0).alias("_all")), "_all", [group])
    outer = root_paths(languages, "_all").select(F.col("position").alias("_language"), F.col("path").alias("_rest"), "root")
    named = languages.select(F.col(group).alias("_group"), F.col("position").alias("_at")).join(outer, F.col("_at") == F.col("_language"))
    above = inner.join(named, F.col(group).eqNullSafe(F.col("_group"))).select(group, "position", F.concat("path", "_rest").alias("path"), "subroot", "root")
    return Manifest(leaves, materialize(above), group)


def document_manifest(docs: DataFrame, tampered: Column) -> Manifest:
    """The tree over ``documents`` rows by language and id; where ``tampered``, a version has the text's A-Z in lower case."""
    text = F.col("text")
    changed = F.when(F.coalesce(tampered, F.lit(False)), document_leaf(lower_ascii(text)))
    return manifest(docs.select("doc_id", "lang", document_leaf(text).alias("node"), changed.alias("tampered")), "lang", ["doc_id"])

"""Packing documents into as few sequences as possible by bin completion.

A document's ids plus a separator are cut, from the end, into pieces of one sequence's length; the first piece may be
shorter. Pieces are dealt to groups of bounded size by hash, and every group is packed by itself. What each group
leaves far from full is pooled with what the others leave and packed again, in groups of such sequences, so that dealing costs
next to nothing.

Inside a group, sequences are completed around the largest piece that is left. Fillings of its remaining room are enumerated
largest piece first; a filling is kept only if no other dominates it (a piece outside could take the place of smaller
pieces inside and still fit). The least waste goes first. A branch ends when its waste exceeds what the incumbent allows;
the first incumbent is best-fit decreasing, and reaching the lower bound ends the search.

Defined results: a null text is empty; an empty document is one piece holding the separator; repeated rows are packed
once each; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import map_texts
from hiregrain.llm.tokens import chunk_ids
from hiregrain.session import materialize

ROOM = 2_048
SEPARATOR = 0
GROUP_SEQUENCES = 2_048
GROUP_PIECES = 40_000
CHOICES = 4  # fillings of one sequence that the search may come back to
STEPS = 200  # steps of one enumeration
OPEN = 8  # sequences with an eighth or more left are packed again with those of other groups
NODES = 600  # sequences the search may complete in a group, beyond its first descent


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        out = []
        for packed in chunk_ids(tokenizer).encode([t or "" for t in texts]):
            packed += SEPARATOR.to_bytes(4, "little")
            n = len(packed) // 4
            bounds = [0, *range(n % room or room, n + 1, room)]
            made = []
            for number, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                part = packed[4 * a : 4 * b]
                made.append({"piece": number, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part), "ids": np.frombuffer(part, "<u4").tolist() if with_ids else None})
            out.append(made)
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
        return {"_made": pa.array(out, pa.list_(kind))}

    made = map_texts(docs.select(id_column, text), work, "_made array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>", text, 128)
    return made.select(id_column, F.inline("_made")).drop(*([] if with_ids else ["ids"]))


def lower_bound(sizes: Counter, room: int) -> int:
    """Fewest sequences that any packing needs: the sum's bound, or the pieces over half, improved by what can't join them."""
    best = -(-sum(s * n for s, n in sizes.items()) // room)
    ordered = sorted(sizes)
    for k in [0, *[s for s in ordered if s <= room // 2][-64:]]:
        alone = sum(n for s, n in sizes.items() if s > room - k)
        halves = [(s, n) for s, n in sizes.items() if room // 2 < s <= room - k]
        rest = sum(s * n for s, n in sizes.items() if k <= s <= room // 2) - sum((room - s) * n for s, n in halves)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-rest // room)))
    return best


def best_fit(sizes: Counter, room: int) -> list[list[int]]:
    """Best-fit decreasing: every piece into the fullest sequence that has room for it."""
    done: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, number), ascending
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            at = bisect_left(free, (size, -1))
            if at == len(free):
                left, number = room, len(done)
                done.append([])
            else:
                left, number = free.pop(at)
            done[number].append(size)
            if left > size:
                entry = (left - size, number)
                free.insert(bisect_left(free, entry), entry)
    return done


def dominated(filling: list[int], room: int, sizes: Counter, ordered: list[int]) -> bool:
    """Whether one piece outside could replace up to two pieces inside, or join them, and waste less; ``ordered`` ascends."""
    free = room - sum(filling)
    used = Counter(filling)
    for gone in {0, *filling, *(a + b for i, a in enumerate(filling) for b in filling[i + 1 :])}:
        at = bisect_left(ordered, gone + 1)
        while at < len(ordered) and ordered[at] <= gone + free:
            if sizes[ordered[at]] > used[ordered[at]]:
                return True
            at += 1
    return False


def greedy(room: int, ordered: list[int], sizes: Counter) -> list[int]:
    """The largest piece that fits, as often as it does, then the next: one step a size, however many pieces."""
    chosen: list[int] = []
    at = len(ordered)
    while room and (at := bisect_left(ordered, room + 1, 0, at) - 1) >= 0:
        size = ordered[at]
        times = min(sizes[size], room // size)
        chosen += [size] * times
        room -= size * times
    return chosen


def fillings(room: int, ordered: list[int], sizes: Counter, steps: int = STEPS, choices: int = CHOICES) -> list[list[int]]:
    """Undominated fillings of ``room`` by pieces of ``sizes`` (``ordered`` ascending), least waste first.

    Depth first, largest piece first. The greedy filling is always among them; one without waste ends the enumeration, and
    after ``steps`` the best ones met so far are given.
    """
    first = greedy(room, ordered, sizes)
    found = [(room - sum(first), first)]
    budget = [0 if sum(first) == room else steps]

    def extend(left: int, top: int, chosen: list[int]) -> bool:
        if budget[0] <= 0:
            return True
        budget[0] -= 1
        at = bisect_left(ordered, left + 1, 0, top) - 1
        leaf = True
        while at >= 0:
            size = ordered[at]
            if sizes[size] > chosen.count(size):
                leaf = False
                chosen.append(size)
                over = extend(left - size, at + 1, chosen)
                chosen.pop()
                if over:
                    return True
            at -= 1
        if leaf and chosen != first:
            found.append((left, chosen.copy()))
            return left == 0
        return False

    extend(room, len(ordered), [])
    found.sort(key=lambda f: f[0])
    best = list(islice((f for _, f in found if not dominated(f, room, sizes, ordered)), choices))
    return best or [f for _, f in found[:1]]


def bin_completion(sizes: Counter, room: int, nodes: int = NODES) -> list[list[int]]:
    """Sequences, each a list of piece sizes; never more than best-fit decreasing needs."""
    incumbent = best_fit(sizes, room)
    bound = lower_bound(sizes, room)
    if len(incumbent) == bound:
        return incumbent
    left = Counter(sizes)
    ordered = sorted(s for s in left if left[s])
    total = sum(s * n for s, n in sizes.items())
    stack: list[tuple[list[int], Iterator[list[int]], int]] = []  # completed sequence, its other choices, waste so far
    budget = len(incumbent) + nodes

    def take(one: list[int], sign: int) -> None:
        for s in one:
            before = left[s]
            left[s] += sign
            if before == 0:
                ordered.insert(bisect_left(ordered, s), s)
            elif left[s] == 0:
                ordered.pop(bisect_left(ordered, s))

    def open_next(waste: int) -> bool:
        largest = ordered[-1]
        take([largest], -1)
        options = [[largest, *f] for f in fillings(room - largest, ordered, left)]
        take([largest], 1)
        return advance(iter(options), waste)

    def advance(options: Iterator[list[int]], waste: int) -> bool:
        for one in options:
            spent = waste + room - sum(one)
            if spent <= (len(incumbent) - 1) * room - total:
                take(one, -1)
                stack.append((one, options, waste))
                return True
        return False

    def back() -> bool:
        while stack:
            one, options, waste = stack.pop()
            take(one, 1)
            if advance(options, waste):
                return True
        return False

    while budget > 0:
        budget -= 1
        if not ordered:
            incumbent = [one for one, _, _ in stack]
            if len(incumbent) == bound or not back():
                break
            continue
        waste = stack[-1][2] + room - sum(stack[-1][0]) if stack else 0
        if not open_next(waste) and not back():
            break
    return incumbent


def _placed(table: pd.DataFrame, room: int, order: list[str]) -> pd.DataFrame:
    """The pieces of one group with ``_number`` (of their sequence), ``offset`` and ``_waste`` (of their sequence)."""
    table = table.sort_values(["length", *order], kind="stable").reset_index(drop=True)
    where: dict[int, list[int]] = {}
    for at, size in enumerate(table["length"].tolist()):
        where.setdefault(size, []).append(at)
    number, offset, waste = (np.zeros(len(table), np.int64) for _ in range(3))
    for sequence, sizes in enumerate(bin_completion(Counter(table["length"].tolist()), room)):
        place = 0
        for size in sizes:
            at = where[size].pop()
            number[at], offset[at], waste[at] = sequence, place, room - sum(sizes)
            place += size
    return table.assign(_number=number, offset=offset, _waste=waste)


def pack(made: DataFrame, room: int = ROOM, id_column: str = "doc_id") -> DataFrame:
    """``made`` (see :func:`pieces`) with ``sequence_id`` and ``offset`` (gapless from 0 in its sequence)."""
    tokens, rows = made.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(tokens or 0) // (room * GROUP_SEQUENCES)), -(-rows // GROUP_PIECES))
    dealt = made.withColumn("_group", F.pmod(F.xxhash64(id_column, "piece", "length", "ids_crc32"), F.lit(groups)))
    names, order = made.columns, [id_column, "piece"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", sequence_id long, offset long"

    def pack_group(table: pd.DataFrame) -> pd.DataFrame:
        table = _placed(table, room, order)
        table["sequence_id"] = table["_number"] + (table["_group"].to_numpy() << 32)
        return table[[*names, "sequence_id", "offset", "_waste"]]

    packed = dealt.groupBy("_group").applyInPandas(pack_group, f"{schema}, _waste long")
    if groups == 1:
        return packed.drop("_waste")
    packed = materialize(packed)
    open_ones = F.col("_waste") * OPEN >= room
    left, left_rows = packed.where(open_ones).agg(F.count_distinct("sequence_id"), F.count("*")).first()
    pools = max(1, -(-left // GROUP_SEQUENCES), -(-left_rows // GROUP_PIECES))

    def pack_pool(table: pd.DataFrame) -> pd.DataFrame:
        again = _placed(table.drop(columns=["offset"]), room, order)
        if again["_number"].nunique() >= table["sequence_id"].nunique():
            return table[[*names, "sequence_id", "offset"]]
        again["sequence_id"] = -1 - again["_number"] - (again["_pool"].to_numpy() << 32)
        return again[[*names, "sequence_id", "offset"]]

    pooled = packed.where(open_ones).drop("_waste").withColumn("_pool", F.pmod(F.xxhash64("sequence_id"), F.lit(pools)))
    return packed.where(~open_ones).drop("_waste").unionByName(pooled.groupBy("_pool").applyInPandas(pack_pool, schema))


def pack_documents(docs: DataFrame, tokenizer: str, room: int = ROOM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Where every piece of every document goes; ids themselves stay out of the shuffle."""
    return pack(materialize(pieces(docs, tokenizer, id_column, text, room)), room, id_column)


def _same(columns: list[str]) -> Column:
    """Whether both sides of a join agree, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in columns])


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, room: int = ROOM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` and the documents' ``starts``; at most ``room`` ids each."""
    # An id may be repeated, with other texts too: a piece is known by all that was told of it.
    known = [id_column, "piece", "start", "length", "ids_crc32"]
    ids = pieces(docs, tokenizer, id_column, text, room, with_ids=True).select(*known, "ids").dropDuplicates(known)
    rows = packed.alias("p").join(ids.alias("i"), _same(known)).select("p.sequence_id", "p.offset", "i.ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.offset").alias("starts"))

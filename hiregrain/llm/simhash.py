"""Near-duplicate documents by SimHash.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints within ``max_bits``
differing bits are linked, and the connected groups are the answer.

Links are found with an inverted index over byte positions. Two linked fingerprints differ in at most ``max_bits`` bytes, so
a minimum of positional bytes is sure to agree. A posting list per single byte would hold 1/256 of all fingerprints, so
postings are keyed by several positions together, chosen such that any guaranteed set of agreeing positions contains one
of the choices whole. Within a list the agreeing bytes of each pair are tallied, pairs below the minimum go, and the
others are verified bit by bit. A list is worked on in blocks of fixed size and gives a spanning forest of its links,
never all its pairs.

Eight bytes and few bits make the minimum certain (:func:`near_duplicates`). A shingle similarity of 0.8 turns over some
15 % of all bits, where no number of agreeing bytes is certain, and bits tell similarity badly for few or repeated
shingles. :func:`similar_documents` therefore compares the sets of distinct shingles themselves. Two sets of Jaccard
similarity ``t`` share one of the first ``n - ceil(t n) + 1`` shingles of each, in any one order of all shingles; these are
its postings, those common in a sample last, so that lists are short. Every pair met in a list that sizes and places
don't rule out is decided by the exact similarity of its sets, unless signatures tell before that they share too little: a set's
signature counts its shingles by the leading bits of their hashes, and two sets share at most the sum of the lesser counts.
The sample changes the cost only, never the result.

Defined results: texts without words (null, empty, white space) have fingerprint zero and are linked like any other;
equal fingerprints are one node, however many documents hold it; a component's id is the smallest document id in it;
rows without an id get their component's id too (null if no member has one); extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiregrain.llm.common import map_texts, whole, written
from hiregrain.plans.graphs import components
from hiregrain.session import materialize

SEED = 42
BYTES = 8
BLOCK = 4_096  # fingerprints of one posting list that one task compares with as many others
CHUNK = 1 << 15  # shingles hashed at a time
KEY_BYTES = 3
SAMPLED, COMMON = 4_000, 200_000  # documents sampled for common shingles, and shingles put last; any values give the same result
HOT = 16  # sampled documents that make a shingle's list one to be cut before it is gathered
GATHERED = 1 << 16  # rows of a cut list in one task, on average, if every document were in it
TEXTS = 64  # whose sets of shingles a task holds at a time
TURNS = 8  # nodes that every list is held against at most before all its pairs in different groups are formed
APART = 4  # such pairs per row that are formed without another turn; any values of these give the same result
CELL = 3  # shingles of a set per count of its signature, at most
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # fixed values: the splitmix64 constants


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits per shingle, mixed from its hash; lane 0 is the hash itself."""
    if lane == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + _MIX[0] * np.uint64(lane)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words_per_shingle: int, width: int = BYTES) -> bytes:
    """The fingerprint of one whole text, lowest bits first; ``width`` is a multiple of eight bytes."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: A-Z and ASCII white space only
    if not line:
        return bytes(width)
    starts = [0, *(m.end() for m in re.finditer(b" ", line))]
    ends = [*(s - 1 for s in starts[1:]), len(line)]
    count = max(1, len(starts) - words_per_shingle + 1)
    last = ends[words_per_shingle - 1 :] if len(starts) >= words_per_shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(8 * width, np.int64)
    for at in range(0, count, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], last[at : at + CHUNK], strict=False)], dtype="<u8")
        for lane in range(width // 8):
            bits = np.unpackbits(_lane(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_column: str, text: str, words_per_shingle: int, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, carried columns, node, bits)``: the fingerprint and its node, which is the fingerprint itself if it has eight bytes."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        made = [fingerprint(x, words_per_shingle, width) for x in texts]
        nodes = [int.from_bytes(m, "little", signed=True) if width == BYTES else xxhash.xxh64_intdigest(m, SEED) - (1 << 63) for m in made]
        return {"node": pa.array(nodes, pa.int64()), "bits": pa.array(made, pa.binary())}

    return map_texts(docs.select(id_column, *carry, text), work, "node long, bits binary", text)


def position_sets(agreeing: int, key_bytes: int) -> list[tuple[int, ...]]:
    """Few sets of ``key_bytes`` positions such that any ``agreeing`` of the eight positions contain one whole (greedy)."""
    wanted = {frozenset(c) for c in combinations(range(BYTES), agreeing)}
    sets = list(combinations(range(BYTES), key_bytes))
    chosen = []
    while wanted:
        best = max(sets, key=lambda s: sum(set(s) <= w for w in wanted))
        chosen.append(best)
        wanted = {w for w in wanted if not set(best) <= w}
    return chosen


def _postings(values: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``(key, node)`` for every set of positions; the key is the number of the set and the bytes there."""
    places = np.array(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bits = _matrix(part.column("bits"))
                key = np.broadcast_to(np.arange(len(sets), dtype=np.int64), (len(bits), len(sets)))
                for column in places.T:
                    key = (key << 8) | bits[:, column]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), len(sets)))], names=["key", "node"])

    return values.select("node", "bits").mapInArrow(run, "key long, node long")


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def linked_pairs(a: np.ndarray, b: np.ndarray, agreeing: int, max_bits: int) -> np.ndarray:
    """Which pairs of rows of ``a`` x ``b`` share ``agreeing`` positional bytes and differ in ``max_bits`` bits at most."""
    differ = a[:, None, :] ^ b[None, :, :]
    survive = (differ == 0).sum(axis=2, dtype=np.int32) >= agreeing
    left, right = np.nonzero(survive)
    survive[left, right] = np.bitwise_count(differ[left, right]).sum(axis=1, dtype=np.int32) <= max_bits
    return survive


def forest(bits: np.ndarray, side: np.ndarray, agreeing: int, max_bits: int) -> list[tuple[int, int]]:
    """``(member, root)``, as row numbers, of every linked group of one posting list; ``side`` 0 is compared with 1, or all with all."""
    parent = np.arange(len(bits))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(bits)),) * 2
    slice_rows = max(1, (1 << 23) // max(1, len(right) * bits.shape[1]))  # 8 MiB of differences at a time
    for start in range(0, len(left), slice_rows):
        rows = left[start : start + slice_rows]
        hit = linked_pairs(bits[rows], bits[right], agreeing, max_bits)
        for i in np.flatnonzero(hit.sum(axis=1) > (right is left)):
            mates = right[hit[i]]
            tops = {root(int(rows[i])), *(root(int(x)) for x in np.unique(parent[mates]))}
            top = min(tops)
            parent[list(tops)] = top
            parent[mates] = top
    roots = [root(i) for i in range(len(bits))]
    size = np.bincount(roots, minlength=len(bits))
    return [(i, r) for i, r in enumerate(roots) if size[r] > 1]


def _links(members: DataFrame, agreeing: int, max_bits: int) -> DataFrame:
    """Spanning links of every pair of blocks: ``(node, key)``, the key being one member's node."""
    keys = ["key", "_i", "_j"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table, head: np.ndarray) -> pa.RecordBatch:
            bits, node, side = _matrix(table.column("bits").combine_chunks()), table.column("node").to_numpy(), table.column("_side").to_numpy()
            cuts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1).tolist(), len(head)]
            found = {(int(node[a + i]), int(node[a + r])) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for i, r in forest(bits[a:b], side[a:b], agreeing, max_bits)}
            pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["node", "key"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            head = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
            other = np.flatnonzero((head != head[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last list may go on; it holds at most two blocks
            if cut:
                yield work(table.slice(0, cut), head[:cut])
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield work(held, np.zeros((held.num_rows, 1), np.int64))

    return dealt.mapInArrow(run, "node long, key long")


def _node_links(values: DataFrame, sets: list[tuple[int, ...]], agreeing: int, max_bits: int, block: int) -> DataFrame:
    """``(node, key)``: links that connect what all links between the fingerprints ``values`` (``node``, ``bits``) connect."""
    postings = _postings(values, sets)
    lists = postings.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    # Spark sizes the postings as if a fingerprint had one, and would broadcast them. Merged, a long list's partition is split.
    met = postings.join(lists.hint("merge"), "key")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    met = met.select("key", "node", blocks.alias("_blocks")).withColumn("_own", own).join(values.select("node", "bits"), "node")

    def pair(j):
        return F.struct(F.least("_own", j).alias("_i"), F.greatest("_own", j).alias("_j"), (F.col("_own") > j).cast("int").alias("_side"))

    dealt = met.select("key", "node", "bits", F.inline(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), pair)))
    return _links(dealt, agreeing, max_bits).distinct()


def _grouped(docs: DataFrame, id_column: str, text: str, words_per_shingle: int, width: int, sets: list[tuple[int, ...]], agreeing: int, max_bits: int, block: int) -> DataFrame:
    """``(id, node, component_id)`` of every row."""
    marked = materialize(fingerprints(docs, id_column, text, words_per_shingle, width))
    values = marked.groupBy("node").agg(F.min(id_column).alias("_first"), F.min("bits").alias("bits"))
    if width > BYTES:  # small enough to be made anew where the fingerprint is the node
        values = materialize(values)
    groups = components(_node_links(values, sets, agreeing, max_bits, block))  # node, component
    linked = values.select("node", "_first").join(groups, "node")
    smallest = linked.groupBy("component").agg(F.min("_first").alias("component_id"))
    named = linked.join(smallest, "component").select("node", "component_id")
    # Written out, so that the join has an exchange of its own on either side and Spark can split the partition of a
    # fingerprint that many documents hold.
    classes = materialize(values.select("node", "_first").join(named, "node", "left").select("node", F.coalesce("component_id", "_first").alias("component_id")))
    return marked.select(id_column, "node").join(classes, "node").select(id_column, "node", "component_id")


def _agreeing(max_bits: int, key_bytes: int) -> int:
    if not 1 <= key_bytes <= BYTES - max_bits:
        raise ValueError("a key holds at most as many bytes as two linked fingerprints are sure to share")
    return BYTES - max_bits


def near_rows(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 5, max_bits: int = 4, key_bytes: int = KEY_BYTES, block: int = BLOCK
) -> DataFrame:
    """``(id, text_key, group)`` of every row: a hash of its text, and a number shared by all rows connected by linked fingerprints.

    Groups are those of :func:`near_duplicates`, told apart also where ids are missing or repeated.
    """
    agreeing = _agreeing(max_bits, key_bytes)
    keyed = docs.select(F.col(id_column), F.col(text).alias("_text"), F.xxhash64(whole(text)).alias("text_key"))
    marked = materialize(fingerprints(keyed, id_column, "_text", words_per_shingle, BYTES, ("text_key",)))
    values = marked.groupBy("node").agg(F.min("bits").alias("bits"))
    groups = components(_node_links(values, position_sets(agreeing, key_bytes), agreeing, max_bits, block)).withColumnRenamed("component", "group")
    # Written out for the same reason as in _grouped.
    classes = materialize(values.select("node").join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group")))
    return marked.select(id_column, "text_key", "node").join(classes, "node").select(id_column, "text_key", "group")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 5, max_bits: int = 4, key_bytes: int = KEY_BYTES, block: int = BLOCK
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``; every link is found.

    ``key_bytes`` is how many positions a posting's key holds: 3 give 23 postings a fingerprint (for 4 bits) and lists
    of ``n / 2**24`` by chance, right up to about 10**9 different fingerprints; 4 give 70 and lists of ``n / 2**32``.
    """
    agreeing = _agreeing(max_bits, key_bytes)
    out = _grouped(docs, id_column, text, words_per_shingle, BYTES, position_sets(agreeing, key_bytes), agreeing, max_bits, block)
    return out.select(id_column, F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending; none of a text without words."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not line:
        return np.zeros(0, "<i8")
    starts = [0, *(m.end() for m in re.finditer(b" ", line))]
    ends = [*(s - 1 for s in starts[1:]), len(line)]
    last = ends[words_per_shingle - 1 :] if len(starts) >= words_per_shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    made = [np.zeros(0, "<u8")]
    for at in range(0, len(last), CHUNK):
        made.append(np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], last[at : at + CHUNK], strict=False)], dtype="<u8")))
    return np.unique(np.concatenate(made).view("<i8"))


def _set_node(hashes: np.ndarray) -> int:
    """The node of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *arrays]))


def _common_shingles(docs: DataFrame, text: str, words_per_shingle: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more sampled documents hold, ascending, and how many do."""
    share = SAMPLED / max(1, n)
    sampled = docs.select(text) if share >= 1 else docs.select(text).sample(share, SEED)
    exploded = map_texts(sampled, lambda texts, _: {"s": _lists([shingles(x, words_per_shingle) for x in texts])}, "s array<long>", text).select(F.explode("s").alias("s"))
    held = exploded.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toPandas().sort_values("s")
    return held["s"].to_numpy(np.int64), held["n"].to_numpy(np.int64)


def prefix(hashes: np.ndarray, similarity: Fraction, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones before common ones, of which a similar set's share one; and how many come before very common ones."""
    keys, counts = common
    rank = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        rank = np.where(keys[at] == hashes, counts[at], 0)
    least = -(-len(hashes) * similarity.numerator // similarity.denominator)
    first = np.lexsort((hashes, rank))[: len(hashes) - least + 1] if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], int((rank[first] < HOT).sum())


def may_be_similar(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sets of these sizes that share a shingle at these places, and none before, can be similar."""
    most = np.minimum(size_a - pos_a, size_b - pos_b)
    return most * (similarity.numerator + similarity.denominator) >= (size_a + size_b) * similarity.numerator


def signature(hashes: np.ndarray) -> bytes:
    """How many of a set's shingles have which leading bits; the set's size decides how many bits. 255 stands for any more."""
    bits = max(3, (len(hashes) // CELL).bit_length())
    cells = (hashes.view("<u8") >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_share_enough(left: list[bytes], right: list[bytes], sizes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether the sets of these signatures can be similar; ``sizes`` are the sums of both sets' sizes."""
    most = np.zeros(len(left), np.int64)
    levels = np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64)
    for level in np.unique(levels).tolist():
        at = np.flatnonzero(levels == level)
        step = max(1, (1 << 20) // level)
        for start in range(0, len(at), step):
            part = at[start : start + step]
            shared = np.minimum(_folded([left[i] for i in part], level), _folded([right[i] for i in part], level))
            most[part] = np.where((shared >= 255).any(axis=1), 1 << 40, shared.sum(axis=1, dtype=np.int64))
    return most * (similarity.numerator + similarity.denominator) >= sizes * similarity.numerator


def _folded(signatures: list[bytes], level: int) -> np.ndarray:
    """The signatures by as few leading bits as ``level`` counts need."""
    made = np.zeros((len(signatures), level), np.int32)
    for length in {len(x) for x in signatures}:
        at = [i for i, x in enumerate(signatures) if len(x) == length]
        cells = np.frombuffer(b"".join(signatures[i] for i in at), np.uint8).reshape(len(at), level, -1).astype(np.int32)
        made[at] = np.where(cells == 255, 1 << 20, cells).sum(axis=2)
    return made


def _met_pairs(members: DataFrame, similarity: Fraction) -> DataFrame:
    """``(a, b)``, ``a < b``: pairs of nodes of one block pair, not yet in one group, that may be similar."""
    keys = ["key", "_i", "_j"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys, "node")
    columns = ["node", "group", "size", "pos", "_side"]

    def pairs(part: np.ndarray, signatures: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(part):
            return
        groups, counts = np.unique(part[:, 1], return_counts=True)
        outside = part[:, 1] != groups[counts.argmax()]  # pairs inside the largest group need no look
        split = bool(part[:, 4].any())
        lefts, rights = (np.flatnonzero(part[:, 4] == 0), np.flatnonzero(part[:, 4] == 1)) if split else (np.arange(len(part)),) * 2
        yield from crossed(part, signatures, lefts[outside[lefts]], rights, not split, outside)
        if split:
            yield from crossed(part, signatures, lefts[~outside[lefts]], rights[outside[rights]], False, outside)

    def crossed(part: np.ndarray, signatures: np.ndarray, lefts: np.ndarray, rights: np.ndarray, one_side: bool, outside: np.ndarray) -> Iterator[pa.RecordBatch]:
        right = part[rights]
        step = max(1, (1 << 17) // max(1, len(right)))
        for start in range(0, len(lefts), step):
            left = part[lefts[start : start + step]]
            x, y = left[:, None, :], right[None, :, :]
            hit = (x[..., 1] != y[..., 1]) & may_be_similar(x[..., 2], x[..., 3], y[..., 2], y[..., 3], similarity)
            if one_side:  # of two rows outside the largest group, each pair once
                hit &= ~outside[rights][None, :] | (x[..., 0] < y[..., 0])
            i, j = np.nonzero(hit)
            stay = may_share_enough(signatures[lefts[start + i]].tolist(), signatures[rights[j]].tolist(), left[i, 2] + right[j, 2], similarity)
            a, b = left[i[stay], 0], right[j[stay], 0]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_head, held_signs = np.zeros((0, 5), np.int64), np.zeros((0, 3), np.int64), np.zeros(0, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])])
            held_head = np.concatenate([held_head, np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])])
            held_signs = np.concatenate([held_signs, np.array([*batch.column("sign").to_pylist(), None], object)[:-1]])
            cuts = [0, *(np.flatnonzero((held_head[1:] != held_head[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from pairs(held[a:b], held_signs[a:b])
            held, held_head, held_signs = held[cuts[-1] :], held_head[cuts[-1] :], held_signs[cuts[-1] :]  # the last list may go on
        yield from pairs(held, held_signs)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _plausible(pairs: DataFrame, values: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose signatures don't rule them out."""

    def side(n: str) -> DataFrame:
        return values.select(F.col("node").alias(n), F.col("size").alias(f"_size_{n}"), F.col("sign").alias(f"_sign_{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_size_a").to_numpy() + batch.column("_size_b").to_numpy()
            stay = may_share_enough(batch.column("_sign_a").to_pylist(), batch.column("_sign_b").to_pylist(), sizes, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, text: str, values: DataFrame, words_per_shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs whose sets of shingles have this similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(values.join(nodes, "node", "left_semi").select("text_key").distinct())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part, made = batch.slice(start, TEXTS), []
                for key, x in zip(part.column("text_key").to_pylist(), part.column("_text"), strict=True):
                    if key not in seen:
                        seen.add(key)
                        made.append(shingles(x.as_py(), words_per_shingle))
                yield pa.RecordBatch.from_arrays([pa.array([_set_node(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], names=["node", "held"])

    texts = docs.select(F.xxhash64(whole(text)).alias("text_key"), F.col(text).alias("_text")).join(wanted, "text_key", "left_semi")
    sets = written(texts.mapInArrow(hashed, "node long, held binary").dropDuplicates(["node"]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<i8"), np.frombuffer(y.as_py(), "<i8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * similarity.denominator >= similarity.numerator * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n, held: sets.select(F.col("node").alias(n), F.col("held").alias(held))
    return written(pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").mapInArrow(exact, "a long, b long"))


def _joined(links: DataFrame) -> DataFrame:
    """``(node, group)`` of all nodes that have a link."""
    members = links.select(F.col("a").alias("node"), F.col("a").alias("key")).union(links.select(F.col("b").alias("node"), F.col("a").alias("key")))
    return components(members).withColumnRenamed("component", "group")


def similar_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``(id, text_key, group)`` of every row: a hash of its text, and a number shared by all rows connected by similar texts."""
    wanted = Fraction(str(similarity))
    if not 0 < wanted <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    n = docs.count()
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, text, words_per_shingle, n))

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        made = [shingles(x, words_per_shingle) for x in texts]
        first, cold = zip(*[prefix(m, wanted, common.value) for m in made]) if made else ([], [])
        return {
            "node": pa.array([_set_node(m) for m in made], pa.int64()),
            "size": pa.array([len(m) for m in made], pa.int64()),
            "prefix": _lists(list(first)),
            "cold": pa.array(cold, pa.int32()),
            "sign": pa.array([signature(m) for m in made], pa.binary()),
        }

    keyed = docs.select(F.col(id_column), F.col(text).alias("_text"), F.xxhash64(whole(text)).alias("text_key"))
    marked = written(map_texts(keyed, work, "node long, size long, prefix array<long>, cold int, sign binary", "_text", TEXTS).withColumn("_row", F.monotonically_increasing_id()))
    one = written(marked.groupBy("node").agg(F.min("_row").alias("_row")).select("_row"))
    values = marked.join(one, "_row", "left_semi").select("node", "text_key", "size", "prefix", "cold", "sign")
    postings = values.select("node", "size", "cold", F.posexplode("prefix").alias("pos", "key"))
    # One shuffle gathers the lists. Those that the sample tells to be long are cut, each part in a task of its own; rows that
    # nobody shares a shingle with go here.
    cut = F.when(F.col("pos") >= F.col("cold"), 1 + F.pmod("node", F.lit(-(-n // GATHERED)))).otherwise(0)
    alike = Window.partitionBy("key", "_cut")
    listed = postings.select("key", cut.alias("_cut"), "node", "size", "pos").select("*", F.count("*").over(alike).alias("_n"), F.min(F.struct("node", "size", "pos")).over(alike).alias("_star"))
    met = written(listed.where("_n > 1 or _cut > 0"))

    # Every list's nodes are held against its first node, so that a list of many copies is one group by then and its
    # pairs need no look; then all pairs of a list that are in different groups.
    most = F.least(F.col("size") - F.col("pos"), F.col("_star.size") - F.col("_star.pos"))
    near = most * (wanted.numerator + wanted.denominator) >= (F.col("size") + F.col("_star.size")) * wanted.numerator
    first = written(met.where(F.col("node") != F.col("_star.node")).where(near).select(F.col("_star.node").alias("a"), F.col("node").alias("b")).distinct())
    links = _similar(written(_plausible(first, values, wanted)), docs, text, values, words_per_shingle, wanted)
    rest = met.where("_n > 2 or _cut > 0").select("key", "node", "size", "pos")  # a list of two has been looked at
    tested = first
    for turn in range(1, TURNS + 1):
        grouped = written(rest.join(_joined(links), "node", "left").withColumn("group", F.coalesce("group", "node")))
        counts = grouped.groupBy("key", "group").agg(F.count("*").alias("_c"))
        lists = counts.groupBy("key").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_same"), F.count("*").alias("_groups"))
        mixed = written(lists.where("_groups > 1"))
        apart, gathered = mixed.agg(F.sum(F.col("_n") * F.col("_n") - F.col("_same")) / 2, F.sum("_n")).first()
        if turn == TURNS or not gathered or apart <= APART * gathered:
            break
        # Many pairs of a list are in different groups still. Another node of the list, first in another order that all lists share, is
        # held against those outside its group, so that a large group of near copies comes together before pairs are formed.
        grouped = grouped.join(mixed.select("key"), "key")
        stars = grouped.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "size", "pos", "group")).alias("_star"))
        near = most * (wanted.numerator + wanted.denominator) >= (F.col("size") + F.col("_star.size")) * wanted.numerator
        met_now = grouped.join(stars, "key").where(F.col("group") != F.col("_star.group")).where(near)
        pairs = met_now.select(F.least("node", "_star.node").alias("a"), F.greatest("node", "_star.node").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        links = links.union(_similar(written(_plausible(pairs, values, wanted)), docs, text, values, words_per_shingle, wanted))
        rest = grouped.drop("group")
    blocked = mixed.select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    placed = grouped.join(blocked, "key").withColumn("_own", own).join(values.select("node", "sign"), "node")

    def pair(j):
        return F.struct(F.least("_own", j).alias("_i"), F.greatest("_own", j).alias("_j"), (F.col("_own") > j).cast("int").alias("_side"))

    dealt = placed.select("key", "node", "group", "size", "pos", "sign", F.inline(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), pair)))
    more = written(_met_pairs(dealt, wanted).join(tested, ["a", "b"], "left_anti"))
    links = links.union(_similar(more, docs, text, values, words_per_shingle, wanted))
    # Written out, so that the join has an exchange of its own on either side and Spark can split the partition of a set
    # of shingles that many documents hold.
    classes = materialize(values.select("node").join(_joined(links), "node", "left").select("node", F.coalesce("group", "node").alias("group")))
    return marked.select(id_column, "text_key", "node").join(classes, "node").select(id_column, "text_key", "group")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The id and ``component_id`` of every document; linked are documents of this Jaccard similarity of shingles, and all of them."""
    rows = materialize(similar_rows(docs, id_column, text, words_per_shingle, similarity, block))
    smallest = materialize(rows.groupBy("group").agg(F.min(id_column).alias("component_id")))
    return rows.select(id_column, "group").join(smallest, "group").select(id_column, "component_id")

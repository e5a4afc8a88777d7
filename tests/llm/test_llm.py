"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hiregrain.llm import chat, checks, exact, lines, packing, pieces, pii, search, sharding, simhash, toxicity
from hiregrain.llm.tokens import ChunkIds

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_n int, _id int, _row string, shard int, slot int, score double, kept boolean, component string, node int, key int, position int"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def path(name):
    return checks.vocabulary(name)


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def cluttered(df):
    """The same rows with columns whose names operators use inside."""
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ") if c.split()[0] not in df.columns})


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


ODD = [None, "", " ", "\n", "\n\n", "a", "A", "same text here", "Same TEXT here", "Same TEXT here", "İstanbul", "istanbul", "x" * 70_000, "word " * 9_000, "\t a b\x0b", "ÀÉ", "àé"]


# Sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = spark.range(1 << dims * bits).select(*[F.shiftright("id", i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{i}") for i in range(dims)])
    rows = cells.select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_follow_their_law(spark, law):
    ids = [None, 7, 7, *range(10, 510)]
    docs = table(spark, [("ab" * (i % 90)) if i % 7 else None for i in range(503)], ids)
    slim = cluttered(docs.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8))
    placed = sharding.hilbert_shards(slim, "doc_id", sharding.document_levels(docs), "size", 24, law=law)
    rows = placed.collect()
    assert len(rows) == 503
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r["_cell"] for r in ordered] == sorted(r["_cell"] for r in rows)


def test_shards_of_few_and_no_rows(spark):
    few = table(spark, ["a", None])
    assert collected(sharding.shard_documents(few), "slot") == [(0,), (0,)]
    assert sharding.shard_documents(few.limit(0)).collect() == []
    ranges = sharding.shard_ranges(sharding.shard_documents(table(spark, ODD)), ["size"]).collect()
    assert sum(r["rows"] for r in ranges) == len(ODD)


def test_written_shards_can_be_read(spark, tmp_path):
    placed = sharding.shard_documents(table(spark, ODD), 3)
    sharding.write_shards(placed, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# SentencePiece


def test_bpe_pieces_equal_the_public_encoder(spark):
    import sentencepiece

    model = path(checks.PIECE_BPE)
    public = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(5)
    texts = [*ODD, "= " * 300, "=" * 1000, "漢字ﬁ①é́ x", "ab" * 3000, *["".join(rng.choice("abcdeitonrs  \n_-=éü") for _ in range(rng.randint(0, 80))) for _ in range(300)]]
    docs = cluttered(table(spark, texts))
    rows = {r.doc_id: r for r in pieces.encode(docs, model).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == public.encode(t or "")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    report = {r.doc_id: r for r in pieces.encoding_report(docs, model).collect()}
    assert all(r.exact for r in report.values()) and report[0].n_ids == 0


def test_unigram_pass_equals_a_whole_text_search():
    vocabulary = [("a", -2.0), ("b", -2.0), ("ab", -2.5), ("ba", -3.1), ("aba", -3.3), ("▁a", -3.0), ("▁", -4.0)]
    model, rng = pieces.Pieces.of(vocabulary), random.Random(1)

    def best(s):
        scores = [0.0]
        for end in range(1, len(s) + 1):
            options = [scores[b] + (model.scores[model.ids[s[b:end]]] if s[b:end] in model.ids else model.worst) for b in range(max(0, end - 3), end) if s[b:end] in model.ids or b == end - 1]
            scores.append(max(options))
        return scores[-1]

    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 300)))
        ids = np.frombuffer(model.encode(text), "<i4").tolist()
        assert abs(sum(model.scores[i] if i else model.worst for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-6


def test_decoding_holds_only_unfinished_characters():
    model = pieces.Pieces(path(checks.PIECE_BPE))
    ids = np.frombuffer(model.encode("①②x"), "<i4").tolist()
    assert "".join(model.decode_stream(iter(ids))) == "①②x"


# SimHash


def brute_fingerprint(text, words_per_shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + words_per_shingle]) for i in range(max(1, len(words) - words_per_shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    listed = sorted(values)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if linked(a, b):
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def near_texts():
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(120)) for _ in range(12)]
    texts = [*ODD, *base]
    for b in base:
        for _ in range(6):
            words = b.split()
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [4_096, 3])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = near_texts()
    rows = {r.doc_id: r for r in simhash.near_duplicates(cluttered(table(spark, texts)), words_per_shingle=4, block=block).collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    roots = brute_components(set(prints.values()), lambda a, b: bin(a ^ b).count("1") <= 4)
    smallest = {}
    for i in sorted(prints):
        smallest.setdefault(roots[prints[i]], i)
    assert {i: r.component_id for i, r in rows.items()} == {i: smallest[roots[p]] for i, p in prints.items()}
    assert len(set(smallest)) < len(set(prints.values()))  # some links are there to find


def test_forest_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 256, (5, 8), dtype=np.uint8)
    bits = centres[rng.integers(0, 5, 60)].copy()
    for row in bits:
        for b in rng.integers(0, 64, 3):
            row[b // 8] ^= 1 << (b % 8)
    ints = [int.from_bytes(r.tobytes(), "little") for r in bits]
    for side in (np.zeros(60, int), np.arange(60) % 2):
        cross = side.any()
        roots = brute_components(range(60), lambda a, b: bin(ints[a] ^ ints[b]).count("1") <= 4 and (not cross or side[a] != side[b]))  # noqa: B023
        made = dict(simhash.forest(bits, side, 4, 4))
        assert all((made.get(a, a) == made.get(b, b)) == (roots[a] == roots[b]) for a in range(60) for b in range(60))


def test_any_guaranteed_positions_hold_a_key():
    from itertools import combinations

    for agreeing, size in ((4, 3), (4, 4), (5, 2), (6, 3)):
        sets = simhash.position_sets(agreeing, size)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), agreeing))


def test_postings_are_not_broadcast(spark):
    values = spark.range(200).select(F.col("id").alias("node"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("bits"))
    plan = simhash._node_links(values, simhash.position_sets(4, 3), 4, 4, 4_096)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan  # 23 postings a fingerprint, sized as one


def test_similar_documents_by_shingles(spark):
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)) for _ in range(30)]
    near = [" ".join("changed" if i in (50, 250) else w for i, w in enumerate(b.split())) for b in base]  # similarity 0.95
    far = [" ".join("changed" if i % 9 == 0 else w for i, w in enumerate(b.split())) for b in base]  # about 0.3
    rows = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, base + near + far)).collect()}
    assert all(rows[30 + i] == i for i in range(30))
    assert all(rows[60 + i] == 60 + i for i in range(30))


def brute_shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_similar(texts, least=(4, 5)):
    """The smallest row number of every row's group: at least four fifths of two sets' shingles are shared."""
    sets = [brute_shingles(t) for t in texts]
    alike = lambda a, b: sets[a] == sets[b] or least[1] * len(sets[a] & sets[b]) >= least[0] * len(sets[a] | sets[b]) > 0
    roots, smallest = brute_components(range(len(texts)), alike), {}
    for i in range(len(texts)):
        smallest.setdefault(roots[i], i)
    return {i: smallest[roots[i]] for i in range(len(texts))}


@pytest.mark.parametrize("block", [4_096, 3])
def test_similar_documents_equal_all_pairs(spark, block):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    say = lambda n: [word() for _ in range(n)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in (8, 9, 10, 14, 20):  # few shingles: one more word is a similarity of 4/5, 5/6, 6/7 ...
        w = say(n)
        texts += [" ".join(w), " ".join([*w, word()]), " ".join([*w, word(), word()])]
    for n in (40, 104, 400):
        for _ in range(5):
            w = say(n)
            texts.append(" ".join(w))
            for extra in range(n * 15 // 100, n * 30 // 100, 2):  # similarities on both sides of 0.8
                texts.append(" ".join([*w, *say(extra)]))
    passage = " ".join(say(11))
    for _ in range(4):  # a passage repeated many times and 100 words of its own
        texts.append(" ".join([passage] * 300 + say(100)))
    head = " ".join(say(30))
    texts += [f"{head} {' '.join(say(60))}" for _ in range(20)]  # a common beginning
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(cluttered(table(spark, texts)), block=block).collect()}
    want = brute_similar(texts)
    assert got == want
    assert 20 < len(set(want.values())) < len(texts)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(table(spark, ["a"]).limit(0)).collect() == []


# Lines


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if i is None or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        out.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    return out


def test_lines_equal_brute_force(spark):
    shared = "  A Line That REPEATS\t"
    texts = [*ODD, f"x\n{shared}\n{shared}\ny", f"{shared.lower()}\nz", f"own line of this\n\n{shared}x", shared, "ÀÉ upper stays\nàé upper stays", "tiny\ntiny", "tiny", "only here twice\nonly here twice"]
    ids = [*range(len(texts) - 4), None, 3, 3, 90]
    docs = table(spark, texts, ids)
    made = lines.dedup_lines(cluttered(docs))
    assert collected(made.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", "n_lines", "n_dropped") == sorted(brute_lines(list(zip(ids, texts))), key=str)
    assert lines.dedup_lines(docs.limit(0)).collect() == []
    assert set(cluttered(docs).columns) <= set(made.columns)


# Toxicity


def test_folding():
    assert toxicity.fold("Th1s is @ST0RY, naïve") == ["this", "is", "astory", "naive"]
    assert toxicity.fold("іdіоt") == ["idiot"] and toxicity.fold("ｉｄｉｏｔ id​iot") == ["idiot", "idiot"]


def test_longest_term_and_exceptions_win():
    machine = toxicity.Lexicon({toxicity.term("trash", whole=False): 3.0, toxicity.term("trash can"): 0.0, " trashy": 1.0}).automaton()
    assert toxicity.measures("trash trash can tr4shy", machine)[3] == 2
    assert toxicity.measures(None, machine) == (0.0, 0.0, 0.0, 0)


def test_toxicity_learns_and_keeps_held_out_rows_apart(spark):
    rng = random.Random(4)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["zorgluk", "vilemutter"]
    texts, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts[1] = None
    docs = cluttered(table(spark, texts))
    known = spark.createDataFrame([*labels, (5, 0), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, known)
    rows = toxicity.score(docs, lexicon).select("doc_id", "score", "predicted", toxicity.held_out("doc_id").alias("held")).collect()
    assert {r.doc_id for r in rows if r.held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == labels[r.doc_id][1] for r in rows if r.held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), lexicon).collect() == []
    nothing = toxicity.learn(docs, known.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    swapped = toxicity.learn(docs, known.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert swapped == lexicon  # held-out labels have no say


@given
def test_toxicity_held_out_accuracy(spark):
    folder = FOLDER.replace("0.001", "0.1")
    scored = checks.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r.score for r in scored if r.toxic == 1], [r.score for r in scored if r.toxic == 0]
    ranked = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert ranked > 0.9
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.95


# Exact duplicates


@pytest.mark.parametrize("bits", [15, 23])
def test_exact_groups_equal_brute_force(spark, bits):
    texts = [*ODD, *[f"{'p' * 64}{i % 4}" for i in range(9)], *[f"{i:03}" for i in range(60)]]
    docs = cluttered(table(spark, texts))
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[fold(t)].append(i)
    made = exact.exact_groups(docs, bits=bits, carry=["lang"])
    want = sorted(((i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)])) for i, t in enumerate(texts)), key=str)
    assert collected(made, "doc_id", "keep_id", "group_size", "kept") == want
    assert exact.exact_groups(docs.limit(0)).collect() == []


def test_exact_groups_without_ids(spark):
    rows = exact.exact_groups(table(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in rows if r.keep_id) == [(False, 4, 2, True), (True, 4, 2, False)]
    assert [(r.group_size, r.kept) for r in rows if r.keep_id is None] == [(1, True)]
    assert sum(bool(r.kept) for r in rows) == 2


# Packing


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(6)

    def fewest(items, room):
        best = [len(items)]

        def place(i, free):
            if len(free) >= best[0]:
                return
            if i == len(items):
                best[0] = len(free)
                return
            for j in range(len(free)):
                if free[j] >= items[i] and free[j] not in free[:j]:
                    free[j] -= items[i]
                    place(i + 1, free)
                    free[j] += items[i]
            free.append(room - items[i])
            place(i + 1, free)
            free.pop()

        place(0, [])
        return best[0]

    for case in range(150):
        items = sorted((rng.randint(1, 14) if case % 2 else rng.randint(4, 12) for _ in range(rng.randint(1, 10))), reverse=True)
        made = packing.bin_completion(Counter(items), 20)
        assert sorted(x for b in made for x in b) == sorted(items) and all(sum(b) <= 20 for b in made)
        assert len(made) == fewest(items, 20)


def test_completion_beats_best_fit():
    sizes = Counter([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])  # 40 in all, two tens too many for best fit at some rooms
    for room in (10, 13, 20):
        assert packing.lower_bound(sizes, room) <= len(packing.bin_completion(sizes, room)) <= len(packing.best_fit(sizes, room))


def test_dominated_fillings():
    assert packing.dominated([3, 3], 10, Counter([3, 3, 4]), [3, 4]) and not packing.dominated([6, 4], 10, Counter([6, 4, 3]), [3, 4, 6])
    assert packing.dominated([3], 10, Counter([3, 7]), [3, 7])


def test_fillings_of_many_tiny_pieces():
    assert packing.fillings(2000, [1], Counter({1: 5000})) == [[1] * 2000]
    assert packing.fillings(2000, [1, 7], Counter({1: 5000, 7: 100})) == [[7] * 100 + [1] * 1300]


def test_search_wins_inside_pack(spark, monkeypatch):
    """Sizes that best fit needs one sequence more for, and groups so small that dealing alone would cost many."""
    rng = random.Random(11)
    lost = won = 0
    for _ in range(60):
        sizes = Counter(rng.randint(3, 12) for _ in range(18))
        best, made = len(packing.best_fit(sizes, 20)), len(packing.bin_completion(sizes, 20))
        lost, won = lost + (best > packing.lower_bound(sizes, 20)), won + (made < best)
    assert 0 < won <= lost
    pieces = [(i, 0, 0, rng.randint(200, 1500), i) for i in range(3_000)]
    table = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 64)
    rows = packing.pack(table).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((p[0], p[3]) for p in pieces)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.ROOM
    groups = -(-sum(p[3] for p in pieces) // (packing.ROOM * 64))
    assert len(fill) <= packing.lower_bound(Counter(p[3] for p in pieces), packing.ROOM) * 1.02 and groups > 10


def test_sequences_of_repeated_ids(spark):
    docs = table(spark, ["one text", "another and longer text", "one text", None], [1, 1, 1, None])
    file = path(checks.BYTE_BPE)
    packed = packing.pack_documents(docs, file)
    encode = packing.chunk_ids(file).encode
    want = sorted(x for t in ("one text", "another and longer text", "one text", "") for x in [*np.frombuffer(encode([t])[0], "<u4").tolist(), 0])
    assert sorted(x for r in packing.sequences(packed, docs, file).collect() for x in r.ids) == want


def test_packed_documents(spark):
    import tokenizers

    texts = [*ODD, *["some words to pack " * (i % 40) for i in range(120)]]
    docs = cluttered(table(spark, texts))
    file = path(checks.BYTE_BPE)
    packed = packing.pack_documents(docs, file)
    rows = packed.collect()
    encode = tokenizers.Tokenizer.from_file(file).encode
    ids = {i: [*encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    taken, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        taken[r.doc_id].append((r.piece, r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for i, all_ids in ids.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(taken[i])):
            assert piece == number and start == at and (length == 2048 or number == 0)
            at += length
        assert at == len(all_ids)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(map(len, ids.values())) // 2048) + 1
    made = packing.sequences(packed, docs, file)
    assert sorted(x for r in made.collect() for x in r.ids) == sorted(x for v in ids.values() for x in v)
    assert packing.pack_documents(docs.limit(0), file).collect() == []


def test_ranked_ids_equal_the_general_encoder():
    encoder = ChunkIds(path(checks.BYTE_BPE))
    odd = ["a  b\n\n c\t\tx \n", "  ", " x\x1c!\x1c! y", "it's  'll <|endoftext|> \n<|endoftext|>a", "漢字　テスト   x\x85y \xa0\xa0z", "!!  !\r\n\r\n", *[t or "" for t in ODD]]
    odd += ["a" + " " * 300_000 + "b", "\n" * 60_000, "c" * 200_000, "\ud83d\ude00 e\u0301".encode("utf-16", "surrogatepass").decode("utf-16")]
    assert encoder.ranked is not None
    for text, packed in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# Personal data


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(9)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "00000000255.1.1.1", " ", "-", "5", "٣", "é", "(", "12", "a", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    for text in ("1" * 50_000, "1." * 30_000, "a" * 100_000, "+1" * 20_000, "a@" * 20_000, "1 " * 30_000):
        assert pii.base_spans(text) == brute_base(text) if len(text) < 45_000 else pii.base_spans(text) is not None


def test_estimation_finds_the_liar():
    rng = random.Random(1)
    votes = Counter()
    for _ in range(4000):
        true = rng.random() < 0.7
        right = [0.95, 0.9, 0.5, 0.8, 0.9]
        votes["card", tuple((1 if true else -1) * (1 if rng.random() < p else -1) for p in right), 1] += 1
    reliability, posterior = pii.estimate(votes)
    assert abs(reliability.prior["card"] - 0.7) < 0.05
    assert abs(reliability.table[2, 1, 2] - reliability.table[2, 0, 2]) < 0.1 < reliability.table[0, 1, 2] - reliability.table[0, 0, 2]
    classifier = pii.train(votes, posterior)
    assert classifier.probability("card", (1, 1, -1, 1, 1), 1) > 0.9 > 0.1 > classifier.probability("card", (-1, -1, 1, -1, -1), 1)


def test_spans_are_found_and_masked(spark):
    texts = [*ODD, "write to jo@mail.example.org", "call phone (555) 123-4567 now", "mail: jo [at] example [dot] com", "license version 3.0", "card 378282246310005 amex", "ping host 10.1.2.3, tel +44 20 7946 0958", "jo@mail.example.org jo@mail.example.org"]
    docs = cluttered(table(spark, texts * 3, list(range(3 * len(texts)))))
    classifier = pii.learn(docs)
    found = {r.doc_id: r for r in pii.find(docs, classifier).collect()}
    for i, t in enumerate(texts):
        assert found[i].base == pii.written(brute_base(t or "")) and set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redact(docs, classifier).collect()}
    assert clean[0] is None and clean[len(ODD)] == "write to <EMAIL>" and clean[len(ODD) + 5] == "ping host <IP>, tel <PHONE>"
    assert all(clean[i] == t for i, t in enumerate(ODD))
    assert pii.redact(docs.limit(0), pii.learn(docs.limit(0))).collect() == []


def test_masks_of_overlapping_spans():
    assert pii.masked("0123456789", [("ip", 1, 5), ("card", 3, 8), ("phone", 9, 10)]) == "0<IP>8<PHONE>"


# Chat


def test_turns_are_escaped_reversibly():
    rng = random.Random(2)
    parts = ["\\", "<", "|", "<|", "im_end|>", "\n", "a", "<|im_start|>", " n"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, n))) for n in (5, 9))
        assert chat.parse(chat.format_turn(role, text)[0] + chat.format_turn("x", "y")[0]) == [(role, text), ("x", "y")]
        assert chat.format_turn(role, text)[0].count(chat.START) == 1


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (1024, 256), (5, 0)])
def test_windows_keep_every_turn_and_target(spark, budget, history):
    rng = random.Random(budget)
    rows = []
    for c in [None, *range(40)]:
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "tool\n"])
            rows.append((c, t if rng.random() < 0.9 else 0, role, rng.choice([None, "", "some words " * rng.randint(1, 9), "<|im_end|>\\"])))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(cluttered(turns), path(checks.BYTE_BPE), budget, history)
    made = {r.conv_id: r for r in chat.read_back(windows).collect()}
    wanted = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2] or "", r[3] or "")):
        wanted[c].append((role or "", text or ""))
    for c, said in wanted.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert made[c].n_turns == len(said) and made[c].loss_chars == len(loss)
        assert made[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert made[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        assert w.n_tokens <= budget or (w.over_budget and w.n_history == 0)
        assert w.n_system == 0 or w.window > 0
    assert len(made) == len(wanted)
    assert chat.read_back(chat.format_conversations(turns.limit(0), path(checks.BYTE_BPE))).collect() == []


# Exact search


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(24)], i % 5) for i in range(200)]
    rows += [(i, rows[3][1], 0) for i in range(200, 206)]  # ties
    rows += [(300, None, 1), (310, [float("nan")] * 24, 1), (320, [None] + [0.1] * 23, 1), (330, [float("inf")] * 24, 1), (340, [], 1), (350, [0.0] * 24, 1), (360, [0.5] * 7, 1), (None, [0.5] * 24, 1), (0, rows[0][1], 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    want = set()
    for q, v in usable:
        if q % 50 == 0 and q is not None:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)))
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)}
    assert {tuple(r) for r in search.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect() if r.query_id} == {w for w in want if w[0]}
    assert search.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_branch_and_bound_equals_all_scores():
    rng = np.random.default_rng(1)
    for scale in (3, 200):
        columns = rng.integers(-scale, scale, (40, 500))
        ids = np.sort(rng.choice(10_000, 500, replace=False))
        queries = rng.integers(-scale, scale, (20, 40))
        for number, at, score in search.best_of_block(queries, ids[:20], columns, ids, 7, 8):
            every = queries[number] @ columns
            order = [i for i in np.lexsort((ids, -every)) if ids[i] != ids[number]][:7]
            assert list(at) == order and list(score) == list(every[order])


# Registered queries


@given
@pytest.mark.parametrize("name", sorted(checks.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for one in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {one} AS SELECT * FROM '{FOLDER}/{one}.parquet'")
    made = checks.QUERIES[name](spark, FOLDER)
    cursor = db.execute(checks.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted((tuple(r[n] for n in names) for r in made.collect()), key=str) == sorted(map(tuple, cursor.fetchall()), key=str)


@given
def test_personal_data_query(spark):
    rows = {r.doc_id: r for r in checks.op8_pii(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        base = pii.written(brute_base(r.text or ""))
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert rows[r.doc_id].n_email == base.count("email:")


@given
def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    texts = {}
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in made.collect()}
        made = stage(spark, made, FOLDER).select(*docs.columns).persist()
        texts = {r.doc_id: r.text for r in made.collect()}
        if name == "toxicity":
            gone = set(before) - set(texts)
            assert all(labels.get(i) != 0 for i in gone) and all(texts[i] == before[i] for i in texts)
        elif name == "line_dedup":
            assert {(i, t) for i, t, _, _ in brute_lines(sorted(before.items()))} == {(i, t or "") for i, t in texts.items()}
        elif name == "simhash_near_dedup":
            kept = {t or "" for t in texts.values()}
            assert {t or "" for t in before.values()} >= kept and len(kept) == len(texts)
            first = {}
            for i in sorted(before):
                first.setdefault(before[i] or "", i)
            assert set(texts) <= set(first.values())
        else:
            assert set(texts) == set(before) and not any(brute_base(t or "") for t in texts.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, made, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


def test_near_copies_without_and_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(4)
    said = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(7)]
    copy = [f"{s} more" for s in said]
    rows = [
        (None, said[0]),  # unique, no id
        (None, said[1]), (None, copy[1]),  # a group without ids
        (None, said[2]), (5, copy[2]),  # one of two has an id
        (6, said[3]), (6, said[3]), (6, said[3]),  # identical rows
        (7, said[4]), (7, copy[4]), (8, said[4]),  # a near copy with the same id
        (9, said[5]), (9, said[6]),  # one id, two texts that are not alike
        (None, None), (None, ""),  # no words
    ]
    ids, texts = zip(*rows, strict=True)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table(spark, texts, ids), FOLDER).collect()]
    groups = Counter()
    for i, t in kept:
        assert (i, t) in rows
        groups[(i, next((n for n, s in enumerate(said) if t and t in (s, copy[n])), None))] += 1
    assert groups == Counter({(None, 0): 1, (None, 1): 1, (5, 2): 1, (6, 3): 1, (7, 4): 1, (9, 5): 1, (9, 6): 1, (None, None): 1})


def test_near_copies_are_those_of_linked_fingerprints(spark):
    import corpus_pipeline

    texts = near_texts()
    prints = {i: brute_fingerprint(t, 5) for i, t in enumerate(texts)}
    roots = brute_components(set(prints.values()), lambda a, b: bin(a ^ b).count("1") <= corpus_pipeline.NEAR_BITS)
    smallest = {}
    for i in sorted(prints):
        smallest.setdefault(roots[prints[i]], i)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, texts), FOLDER).collect()]
    assert sorted(kept) == sorted(smallest.values())
    # Fingerprints decide, not the similarity of the sets of shingles.
    assert set(brute_similar(texts).values()) != set(smallest.values())

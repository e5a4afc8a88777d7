"""The Merkle manifest against a plain tree, its versions against whole rebuilt trees."""

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hiregrain.llm import checks, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node int, position int, n int, block int, path int, root string"
SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def fold(tree, at, node, siblings):
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        siblings += [h for i, h in enumerate(run) if i != at % 8]
        run[at % 8] = node
        node, at = sha(*run), at // 8
    return node


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    languages = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in languages}
    trees = {x: levels([leaf(r, r[1]) for r in ordered[x]]) for x in languages}
    top = levels([trees[x][-1][0] for x in languages])
    out = []
    for number, x in enumerate(languages):
        for at, r in enumerate(ordered[x]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            siblings = []
            folded = fold(top, number, fold(trees[x], at, leaf(r, lowered(r[1]) if tampered else r[1]), siblings), siblings)
            out.append((str(r[0]), leaf(r, r[1]), trees[x][-1][0], top[-1][0], sha(*siblings), folded))
    return sorted(out)


def documents(counts):
    rows, at = [], 0
    for lang, n in counts.items():
        for i in range(n):
            at += 1
            rows.append((at * 7919 % 100_003 - 50, [f"Text {at}", "lower", "ÀB", "", None][i % 5], lang, f"s{i % 3}" if i % 4 else None, i if i % 6 else None))
    return rows


COUNTS = [{"en": 1}, {"en": 9}, {"en": 700, "de": 64, None: 65, "fr": 8, "": 1}, {chr(97 + i): 1 + i for i in range(20)}]


@pytest.mark.parametrize("levels_of_block", [4, 1])
@pytest.mark.parametrize("counts", COUNTS, ids=["one", "run", "languages", "many"])
def test_audit_equals_whole_trees(spark, monkeypatch, counts, levels_of_block):
    monkeypatch.setattr(merkle, "LEVELS", levels_of_block)  # with one level, a block is one run and trees are climbed many times
    monkeypatch.setattr(merkle, "SPAN", 8**levels_of_block)
    rows = documents(counts)
    if len(counts) > 1:
        rows += [(None, "No Id", "de", None, None), (None, "no id", "de", None, None), rows[3], rows[3], (rows[3][0], "Other", *rows[3][2:])]
        rows.append((10**7, "Long " * 50_000, "en", None, 1))
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], DOCS)
    made = merkle.document_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")) for r in made.audit("doc_id").collect())
    assert got == brute(rows)


def test_versions_share_what_they_do_not_copy(spark):
    rows = documents({"en": 300, "de": 20})
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], DOCS)
    made = merkle.document_manifest(docs, F.col("doc_id") % 50 == 0)
    versions = {}
    for r in made.versions("doc_id").orderBy("doc_id", "step").collect():
        versions.setdefault(r.doc_id, []).append(r.node)
    changed = {r[0] for r in rows if r[0] % 50 == 0}
    assert set(versions) == changed
    audit = {r.doc_id: r for r in made.audit("doc_id").collect()}
    for doc_id, nodes in versions.items():
        height = 3 if next(r for r in rows if r[0] == doc_id)[2] == "en" else 2
        assert len(nodes) == 1 + height + 1 and nodes[-1] == audit[doc_id].folded_root  # the leaf, the language's levels, the languages' level
    base = made.nodes().collect()
    assert {(r.lang, r.level) for r in base} == {("en", 0), ("en", 1), ("en", 2), ("en", 3), ("de", 0), ("de", 1), ("de", 2)}
    assert {r.node for r in base if (r.lang, r.level, r.at) in (("en", 3, 0), ("de", 2, 0))} == {r.subroot for r in audit.values()}


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.document_manifest(docs, F.lit(True)).audit("doc_id").collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op11_negatives", "op12_merkle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(checks.ORACLES[name])
    names = [d[0] for d in found.description]
    rows = checks.QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in rows.collect()))) == sorted(map(str, found.fetchall()))

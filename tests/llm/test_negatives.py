"""Hard negatives against brute force, and the residue arithmetic against Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiregrain.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int, _d int, q int, rank int, positives string"


def brute(rows, anchor, k, m, low, high):
    """All of it, pair by pair."""
    usable = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, lab in usable:
        if anchor(i) and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    out = []
    for a, (own, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, lab) for i, v, lab in usable if len(v) == len(q)]
        for positive in sorted(s for s in scored if s[2] == own and s[1] != a)[:k]:
            p = -positive[0]
            inside = sorted(s for s in scored if s[2] != own and low * p <= -100 * s[0] <= high * p)[:m]
            out += [(a, positive[1], r, n[1], p, -n[0]) for r, n in enumerate(inside, 1)]
    return sorted(out)


def test_residues_rebuild_any_integer():
    rng = random.Random(3)
    primes = negatives.primes_for((1 << 62) - 1)
    assert math.prod(primes) > 1 << 63 and negatives.SLICE * ((max(primes) - 1) // 2) ** 2 < 1 << 24
    values = [0, 1, -1, (1 << 62) - 1, 1 - (1 << 62), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(200))]
    residues = [np.array([(v + (p - 1) // 2) % p - (p - 1) // 2 for v in values]) for p in primes]
    assert negatives.rebuild(residues, primes).tolist() == values


@pytest.mark.parametrize(("dims", "size"), [(3, 5), (64, 300), (200, 40_000), (130, 1 << 24)])
def test_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-size, size, (7, dims)), rng.integers(-size, size, (9, dims))
    a[0], b[0] = size, size  # the largest score of all
    primes = negatives.primes_for(dims * size * size)
    got = negatives.ResidueMatrix(a, primes).products(negatives.ResidueMatrix(b, primes))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


@pytest.mark.parametrize("block", [8_192, 7])
def test_mining_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(i, [round(rng.uniform(-0.4, 1), 1) for _ in range(5)], rng.choice([1, 1, 1, 2, 3])) for i in range(90)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5, 0.5], 1 + i % 2) for i in range(30)]  # ties: many copies of one vector, in a hot label
    rows += [(10, [0.9] * 5, 2), (300, [0.1, 0.2], 1), (310, [0.3, 0.2], 1), (320, [0.2, 0.2], 2), (330, [-1.0] * 5, 4), (340, [1.0] * 5, 4)]  # a repeated anchor, other lengths, few of a label
    rows += [(None, [0.5] * 5, 1), (400, None, 1), (410, [], 1), (420, [0.5, None, 0.5, 0.5, 0.5], 1), (430, [float("nan")] + [0.5] * 4, 1), (440, [float("inf")] + [0.5] * 4, 1), (450, [0.5] * 5, None)]
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    table = spark.createDataFrame([(*r, 0, 1, 2, "x") for r in rows], VECTORS)
    found = negatives.mine(table, F.col("vec_id") % 10 == 0, 3, 4, (20, 110))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0, 3, 4, 20, 110)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == want and len(want) > 50


def test_mining_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    found = negatives.mine(empty, F.col("vec_id") % 10 == 0)
    assert found.collect() == [] and found.columns[:4] == ["anchor_id", "positive_id", "rank", "negative_id"]

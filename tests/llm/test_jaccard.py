"""The grouped prefix join against brute force over all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import jaccard
from quern.llm.jaccard import JaccardJoin, prefix_size
from quern.sources.workspace import Workspace

SCHEMA = "doc_id long, text string, component long"


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, t):
    sets = [(i, shingle_set(x, k)) for i, x in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y or len(x & y) < t * len(x | y):
                continue
            a_, b_ = sorted((root(i), root(j)))
            parent[b_] = a_
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=str)


def run(spark, rows, k, t, **limits):
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], SCHEMA).repartition(3)
    out = JaccardJoin(k, t, **limits).components(df, Workspace(spark, "test"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, bases, copies, words=40, vocabulary=400):
    rnd = random.Random(seed)
    rows = []
    passage = " ".join(f"p{i}" for i in range(25))
    for _ in range(bases):
        base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, words))]
        if rnd.random() < 0.4:
            base += passage.split()
        for _ in range(rnd.randint(1, copies)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), (" " if rnd.random() < 0.5 else "\n").join(text)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,t,limits", [(3, Fraction(9, 10), {"bucket": 2, "common": 2, "wide": 0}), (5, Fraction(4, 5), {}), (2, Fraction(1, 2), {"bucket": 3, "common": 10**9, "dense": 0, "broadcast_ids": 0})])
def test_against_all_pairs(spark, k, t, limits):
    """By every way that the limits choose between."""
    rows = corpus(int(t * 100) + len(limits), 25, 12)
    assert run(spark, rows, k, t, **limits) == brute(rows, k, t)


def test_bitmaps_lose_no_pair():
    rnd = np.random.default_rng(3)
    t = Fraction(9, 10)
    rows = []
    for n in (1, 2, 30, 100, 700, 9000, 20000):
        x = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        for out, more in ((0, 0), (n // 20, n // 30), (n // 18, 0), (0, n // 9), (n // 3, n // 3)):
            y = np.unique(np.concatenate([x[out:], rnd.integers(0, 2**64, more, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            rows.append((len(x), len(y), jaccard.parity(x), jaccard.parity(y), 10 * both >= 9 * (len(x) + len(y) - both)))
    nx, ny, x, y, linked = zip(*rows, strict=True)
    at = pa.array(range(len(rows)))
    batch = pa.RecordBatch.from_arrays([at, pa.array(nx, pa.int32()), pa.array(ny, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["at", "nx", "ny", "x", "y"])
    kept = set(next(jaccard._likely(t)(iter([batch])))["at"].to_pylist())
    assert {i for i, told in enumerate(linked) if told} <= kept
    assert 2 <= sum(linked) < len(rows) and not kept & {i for i, r in enumerate(rows) if r[0] >= 700 and i % 5 == 4}


def test_hub_of_near_copies(spark):
    """Copies differ from each other by more than from their base, which is not the least id."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(90):
        text = list(base)
        text[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = run(spark, rows, 3, Fraction(9, 10))
    assert got == brute(rows, 3, Fraction(9, 10))


def test_odd_rows(spark):
    rows = [(3, None), (2, ""), (9, "a b"), (8, "A  B\n"), (7, " \t"), (None, "a b"), (5, "a b c d"), (5, "x y z u v"), (4, "x y z u v"), (6, "a b c d"), (6, "a b c d"), (1, "word " * 5000)]
    assert run(spark, rows, 3, Fraction(9, 10)) == sorted(brute([r for r in rows], 3, Fraction(9, 10)), key=str)


def test_empty_table(spark):
    assert run(spark, [], 3, Fraction(9, 10)) == []


def test_prefix_size():
    for n in range(1, 200):
        assert prefix_size(n, Fraction(9, 10)) == n - -(-9 * n // 10) + 1

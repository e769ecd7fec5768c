"""Budgets and selection against a plain loop over the tree, weight 0 and odd rows included."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing
from quern.sources.workspace import Workspace


def _share(budget, children):
    """Budgets of ``{name: (weight, room)}``: full children leave, the others share by weight."""
    given = dict.fromkeys(children, 0.0)
    live = {c for c, (w, room) in children.items() if w > 0 and room > 0}
    while live:
        total = sum(children[c][0] for c in live)
        full = {c for c in live if children[c][1] <= budget * children[c][0] / total + 1e-9}
        if not full:
            for c in live:
                given[c] = budget * children[c][0] / total
            break
        for c in full:
            given[c] = children[c][1]
            budget -= children[c][1]
        live -= full
    return given


def _brute(rows, weights, share, epochs):
    """Copies of each document: ``{(id, epoch): count}``; rows are (id, n0, n1, n2, tokens)."""
    leaf = defaultdict(list)
    for r in rows:
        leaf[r[1:4]].append((r[0], r[4]))
    tokens = {k: sum(t for _, t in v) for k, v in leaf.items()}
    w = lambda depth, path: weights.get((depth, path[depth]), 1.0)
    room = defaultdict(float)
    for k, t in tokens.items():
        if all(w(d, k) > 0 for d in range(3)):
            for d in range(4):
                room[k[:d]] += t * epochs
    budget = {(): math.floor(sum(tokens.values()) * share)}
    for d in range(3):
        for parent in {k[:d] for k in tokens}:
            kids = {k[: d + 1] for k in tokens if k[:d] == parent}
            budget |= _share(budget[parent], {c: (w(d, c), room[c]) for c in kids})
    out = defaultdict(int)
    for k, members in leaf.items():
        if not tokens[k]:
            continue
        b = math.floor(budget[k] + 1e-6)
        whole, rest = divmod(b, tokens[k])
        order = defaultdict(list)
        for i, t in members:
            order[hashlib.md5(f"{mixing.SEED}:{whole}:{'null' if i is None else i}".encode()).hexdigest()].append((i, t))
        taken, sofar = set(), 0
        for p in sorted(order):
            sofar += sum(t for _, t in order[p])
            if sofar > rest:
                break
            taken.add(p)
        for p, own in order.items():
            for i, _ in own:
                for e in range(whole + (p in taken)):
                    out[i, e] += 1
    return dict(out)


@pytest.mark.parametrize("share,epochs,weights", [(0.6, 3, {(0, "a"): 2.0, (1, "x"): 3.0}), (0.9, 1, {(0, "a"): 2.0, (1, "y"): 0.0, (2, "s1"): 0.0}), (0.5, 2, {(0, "b"): 0.0})])
def test_against_loop(spark, share, epochs, weights):
    draw = random.Random(int(share * 10))
    rows = [(i, draw.choice("abc"), draw.choice(["x", "y", None]), f"s{draw.randrange(3)}", draw.choice([0, 1, 5, 30, 400])) for i in range(400)]
    rows += [(None, "a", "x", "s0", 4), (None, "a", "x", "s0", 4), (7, *rows[7][1:]), (7, *rows[7][1:]), (900, None, None, None, 12), (901, "d", "x", "s0", 0)]
    # input columns that are named like inner or added ones
    data = [(i, a, b, c, " ".join(["w"] * t) if t else draw.choice([None, "", "  "]), 1, 2, 3, 4) for i, a, b, c, t in rows]
    df = spark.createDataFrame(data, "doc_id long, a string, b string, c string, text string, _n0 int, _epochs int, _last int, _copies int").repartition(3)
    weight = {d: F.when(F.lit(False), 1.0) for d in range(3)}
    for (d, name), w in weights.items():
        weight[d] = F.when(F.col(f"n{d}") == name, w).otherwise(weight[d])
    out = mixing.mix(df, [F.col("a"), F.col("b"), F.col("c")], weight, Workspace(spark, "test"), share, epochs)
    assert {"_epochs", "_last", "_copies", "_n0", "_epoch"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = {(r["doc_id"], r["_epoch"]): r["count"] for r in out.groupBy("doc_id", "_epoch").count().collect()}
    assert got == _brute(rows, weights, share, epochs) and got
    assert mixing.mix(df.limit(0), [F.col("a"), F.col("b"), F.col("c")], weight, Workspace(spark, "test")).count() == 0

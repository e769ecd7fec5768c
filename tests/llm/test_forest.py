"""Near-duplicate vectors of several dimensions, against all pairs."""

import numpy as np

from quern.llm import forest
from quern.sources.workspace import Workspace


def test_each_dimension_has_its_links(spark):
    draw = np.random.default_rng(4)
    rows = []
    for dim, n in ((8, 30), (5, 12), (3, 4)):
        for v in draw.normal(size=(n, dim)):
            rows += [(len(rows), v.tolist()), (len(rows) + 1, (v + 0.02 * draw.normal(size=dim)).tolist())]
    rows += [(900, rows[70][1]), (901, None), (902, []), (903, [0.0] * 5), (904, [1.0, None, 2.0]), (905, [float("nan")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in forest.near_duplicates(df, Workspace(spark, "test")).collect()}
    sound = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 901}
    links = {i: {j for j, y in sound.items() if j != i and len(x) == len(y) and x @ y >= forest.THRESHOLD} for i, x in sound.items()}
    assert sum(len(s) for i, s in links.items() if len(sound[i]) < 8) >= 30
    assert {i: got[i]["n_links"] for i in sound} == {i: len(s) for i, s in links.items()}
    for i, s in links.items():
        assert all(got[i]["component_id"] == got[j]["component_id"] for j in s)
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (901, 902, 903, 904, 905, None))
    assert forest.near_duplicates(df.limit(0), Workspace(spark, "test")).collect() == []


def _planted(n_base, dim, seed, lo=0.95, hi=0.96):
    """Single precision vectors, each with a partner at a cosine between ``lo`` and ``hi``."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n_base, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = draw.normal(size=(n_base, dim))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = draw.uniform(lo, hi, size=(n_base, 1))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * off]).astype(np.float32) * draw.uniform(0.1, 9, size=(2 * n_base, 1)).astype(np.float32)


def _links(v):
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= forest.THRESHOLD
    np.fill_diagonal(near, False)
    return near


def test_recall_of_deep_trees(spark):
    """Small leaves and blocks and a sample of a tenth: eight splits and more, no link below the threshold."""
    v = _planted(3000, 64, 12)
    near = _links(v)
    tree = forest.grow(forest.normed(v[:600].astype(np.float64)), len(v), forest.SEED, forest.THRESHOLD, 40, 64)

    def depth(node):
        return 0 if tree.left[node] < 0 else 1 + max(depth(tree.left[node]), depth(tree.right[node]))

    assert depth(0) >= 8
    df = spark.createDataFrame([(i, x.tolist(), 1, 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, c int, id int")
    out = forest.near_duplicates(df, Workspace(spark, "test"), sample=600, leaf=40, side=64).collect()
    got = np.array([r["n_links"] for r in sorted(out, key=lambda r: r["vec_id"])])
    assert (got <= near.sum(axis=1)).all()
    recall = got.sum() / near.sum()
    print("recall", recall, "depth", depth(0))
    assert recall >= 0.9


def test_hot_vector(spark):
    """A third of the rows are one vector, a third lie close around another."""
    draw = np.random.default_rng(7)
    far = draw.normal(size=(300, 16))
    hub = draw.normal(size=16)
    close = hub + 0.02 * draw.normal(size=(300, 16))
    v = np.concatenate([np.tile(draw.normal(size=16), (300, 1)), close, far]).astype(np.float32)
    near = _links(v)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    out = sorted(forest.near_duplicates(df, Workspace(spark, "test"), sample=100, leaf=20, side=32).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in out] == near.sum(axis=1).tolist()
    assert [r["component_id"] for r in out[:600]] == [0] * 300 + [300] * 300

"""Near-duplicate embeddings by a forest of random-projection trees with spill.

A tree splits a bounded sample at the median of its projections on a random direction, again and
again until a node stands for few enough vectors.  Every vector, not the sample alone, then runs
down every tree; one that falls within the margin of a split goes to both sides.  Vectors of one
leaf are compared by matrix products in double precision, large leaves in square blocks, so a
leaf is never one task's burden; a node whose vectors nearly all lie in the margin is not split.

A pair that meets in several leaves counts once: in the first tree, and the least leaf of it,
that both vectors are in.  So links are counted where they are found, and what leaves a block is
a count for each vector and one edge for each vector and neighbourhood, never the pairs.  Equal
vectors are one, with a weight.

Vectors that are null, zero or hold null or non-finite components link with nothing.  Vectors of
different numbers of components are not compared; each number has a forest of its own.  Rows of
one id are rows of their own, joined in one component; a null id keeps null and links with
nothing.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.sources.workspace import Workspace

THRESHOLD = 0.95
TREES = 5
#: Vectors that the trees are fitted on: one of ``SHARE``, ``SAMPLE`` at least and ``MOST`` at most.
SAMPLE, SHARE, MOST = 20_000, 50, 200_000
LEAF = 400
#: Rows on a side of a block.
SIDE = 2048
SEED = 20


@dataclass
class Tree:
    """Nodes in order: direction, cut, children (leaves have none), and blocks to a side of each leaf."""

    direction: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    blocks: np.ndarray
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of all rows of ``x``; a row may be in several."""
        rows, nodes = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.left[node] < 0:
                rows.append(own)
                nodes.append(np.full(len(own), node))
                continue
            side = x[own] @ self.direction[node] - self.cut[node]
            todo.append((self.left[node], own[side <= self.margin]))
            todo.append((self.right[node], own[side >= -self.margin]))
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(nodes)


def grow(sample: np.ndarray, total: int, seed: int, threshold: float, leaf: int = LEAF, side: int = SIDE) -> Tree:
    """A tree over ``total`` vectors of which ``sample`` are at hand."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    # half the spread that the difference of a linked pair has along a random direction
    margin = 0.5 * np.sqrt(max(0.0, 2 - 2 * threshold) / dim)
    direction, cut, left, right, blocks = [], [], [], [], []
    scale = total / max(1, len(sample))

    def add(own: np.ndarray) -> int:
        node = len(cut)
        direction.append(np.zeros(dim))
        cut.append(0.0)
        left.append(-1)
        right.append(-1)
        blocks.append(max(1, int(np.ceil(len(own) * scale / side))))
        if len(own) * scale <= leaf or len(own) < 16:
            return node
        for _ in range(4):
            d = rng.standard_normal(dim)
            d /= np.linalg.norm(d)
            along = sample[own] @ d
            middle = float(np.median(along))
            low, high = along <= middle + margin, along >= middle - margin
            if max(low.sum(), high.sum()) <= 0.8 * len(own):
                direction[node], cut[node] = d, middle
                left[node] = add(own[low])
                right[node] = add(own[high])
                return node
        return node

    add(np.arange(len(sample)))
    return Tree(np.array(direction), np.array(cut), np.array(left), np.array(right), np.array(blocks), margin)


def raw(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and which rows are a finite vector of this size that is not zero."""
    out, good = np.zeros((len(column), dim)), np.zeros(len(column), dtype=bool)
    column = column.cast(pa.large_list(pa.float64()))
    size = np.diff(column.offsets.to_numpy())
    fits = np.flatnonzero((size == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    if len(fits):
        flat = column.values.to_numpy(zero_copy_only=False)
        v = flat[column.offsets.to_numpy()[fits][:, None] + np.arange(dim)]
        out[fits] = v
        good[fits] = np.isfinite(v).all(axis=1) & (np.abs(v).max(axis=1) > 0)
    return out, good


def normed(v: np.ndarray) -> np.ndarray:
    """Unit vectors; rows are scaled first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one."""
    out, good = raw(column, dim)
    out[good], out[~good] = normed(out[good]) if good.any() else 0, 0
    return out, good


def _bytes(v: np.ndarray) -> list[bytes]:
    """Rows as bytes: single precision where that is exact, else double."""
    short = v.astype(np.float32)
    exact = (short.astype(np.float64) == v).all(axis=1)
    return [s.tobytes() if e else d.tobytes() for s, d, e in zip(short, v, exact, strict=True)]


def _vectors(values: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, dtype=np.float64 if len(b) == 8 * dim else np.float32) for b in (v.as_buffer() for v in values)], dtype=np.float64)


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row reachable from each of ``n`` rows."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _deal(trees, dim: int):
    """Every vector to the blocks of its leaves, with all its leaves in earlier trees."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            v, _ = raw(batch.column(1), dim)
            x, packed = normed(v), _bytes(v)
            homes: list[list[int]] = [[] for _ in ids]
            for t, tree in enumerate(trees.value):
                rows, nodes = tree.leaves(x)
                n = tree.blocks[nodes]
                own = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                # block b meets blocks b..n-1 as a row and 0..b as a column
                copies = np.repeat(np.arange(len(rows)), n)
                other = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
                mine = own[copies]
                earlier = [np.array(h, dtype=np.int64) for h in homes]
                for r, v in zip(rows.tolist(), nodes.tolist(), strict=True):
                    homes[r].append((t << 32) | v)
                now = [np.array(sorted(homes[r][len(earlier[r]) :]), dtype=np.int64) for r in range(len(ids))]
                lists = [np.concatenate([e, w]) for e, w in zip(earlier, now, strict=True)]
                take = rows[copies]
                off = np.concatenate([[0], np.cumsum([len(lists[r]) for r in take], dtype=np.int64)]).astype(np.int32)
                flat = np.concatenate([lists[r] for r in take]) if len(take) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(take), t, dtype=np.int32)), pa.array(nodes[copies].astype(np.int32)), pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)),
                        pa.array((mine <= other)), pa.array((mine >= other)), pa.array(ids[take]), pa.array(weight[take]), pa.array([packed[r] for r in take], type=pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                    ],
                    names=["tree", "leaf", "i", "j", "row", "col", "id", "weight", "x", "homes"],
                )

    return run


def _compare(threshold: float, dim: int):
    """Counts of links and edges of one block, kind 0: (id, links), kind 1: (id, id)."""

    def run(table: pa.Table) -> pa.Table:
        ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
        x = normed(_vectors(table["x"], dim))
        here = (table["tree"][0].as_py() << 32) | table["leaf"][0].as_py()
        diagonal = table["i"][0].as_py() == table["j"][0].as_py()
        homes = table["homes"].to_pylist()
        most = max(len(h) for h in homes)
        home = np.full((len(ids), most), -1, dtype=np.int64)
        for r, h in enumerate(homes):
            home[r, : len(h)] = h
        rows, cols = np.flatnonzero(table["row"].to_numpy(zero_copy_only=False)), np.flatnonzero(table["col"].to_numpy(zero_copy_only=False))
        links = np.zeros(len(ids), dtype=np.int64)
        left, right = [], []
        for a in range(0, len(rows), 512):
            r = rows[a : a + 512]
            i, j = np.nonzero(x[r] @ x[cols].T >= threshold)
            i, j = r[i], cols[j]
            keep = ids[i] < ids[j] if diagonal else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            for b in range(0, len(i), 200_000):
                p, q = i[b : b + 200_000], j[b : b + 200_000]
                # the first home that both have: homes are in order of tree and leaf
                first = np.full(len(p), np.iinfo(np.int64).max)
                for k in range(most):
                    h = home[p, k]
                    met = (h >= 0) & (home[q] == h[:, None]).any(axis=1)
                    first = np.minimum(first, np.where(met, h, first))
                count = first == here
                p, q = p[count], q[count]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                left.append(p)
                right.append(q)
        left, right = (np.concatenate(s) if s else np.zeros(0, dtype=np.int64) for s in (left, right))
        label = _components(len(ids), left, right)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        some = np.flatnonzero(links)
        return pa.table({"kind": pa.array(np.repeat([0, 1], [len(some), len(moved)]).astype(np.int32)), "a": pa.array(np.concatenate([ids[some], ids[moved]])), "b": pa.array(np.concatenate([links[some], ids[label[moved]]]))})

    return run


def near_duplicates(vectors: DataFrame, ws: Workspace, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, side: int = SIDE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0.0)
    # equal vectors are one: the digest of the values (-0.0 being 0.0) is the key
    marked = rows.withColumn("key", F.when(sound, F.sha2(F.to_json(F.transform("v", lambda c: c + 0.0)).cast("binary"), 256)))
    kinds = ws.save(marked.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("c"), F.count("*").alias("weight")), "kinds")
    kept = ws.save(marked.join(kinds, "key").where("id = c").select("c", "v", "weight", "key").dropDuplicates(["key"]).select("c", "v", "weight"), "distinct")
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    schema = "tree int, leaf int, i int, j int, row boolean, col boolean, id long, weight long, x binary, homes array<long>"
    found = spark.createDataFrame([], "kind int, a long, b long")
    for dim, total in sizes:  # a forest for each number of components
        alike = kept.where(F.size("v") == dim)
        picked = alike.orderBy(F.xxhash64("c", F.lit(SEED)), "c").limit(max(sample, min(MOST, total // SHARE))).select("c", "v").toArrow()
        at, _ = unit(pa.chunked_array(picked["v"]).combine_chunks(), dim)
        order = np.argsort(picked["c"].to_numpy())
        sent = spark.sparkContext.broadcast([grow(at[order], total, SEED + t, threshold, leaf, side) for t in range(trees)])
        dealt = alike.mapInArrow(_deal(sent, dim), schema)
        found = found.unionByName(ws.save(dealt.groupBy("tree", "leaf", "i", "j").applyInArrow(_compare(threshold, dim), "kind int, a long, b long"), f"found{dim}"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("links"))
    edges = found.where("kind = 1").select("a", "b")
    # an id with several vectors holds their kinds together
    of_row = ws.save(marked.select("id", "key").join(kinds, "key", "left").select("id", "c", "weight"), "of_row")
    several = of_row.where("c IS NOT NULL").groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("id")
    edges = edges.unionByName(of_row.where("c IS NOT NULL").join(several, "id").select(F.col("id").alias("a"), F.col("c").alias("b")))
    component = connected_components(edges, ws, "cc").withColumnRenamed("id", "c")
    out = of_row.join(links, "c", "left").join(component, "c", "left")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    out = out.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), F.coalesce("component", "c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.95: ``vec_id, n_links, component_id, kept``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Workspace(spark, "forest"))


OP3_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c))) AS n FROM embeddings
  WHERE embedding IS NOT NULL),
sound AS (SELECT * FROM unit WHERE n > 0 AND isfinite(n)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

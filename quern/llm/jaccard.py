"""Exact Jaccard join on word shingles by grouped prefixes, for whole corpora.

Documents with equal sets are one *class*; classes with equal size and prefix are one *group*.
With shingles in one global order, two sets of Jaccard ``t`` or more share a shingle among the
first ``n - ceil(t n) + 1`` of each, so only groups that share a prefix shingle can hold links.
The order is by hash, except that shingles found in many prefixes come last: what thousands of
documents share is then in no prefix but of documents that hold little else.

Group pairs are filtered by size, by position and by the number of prefix shingles in common.
Pairs of members are then filtered by *parity bitmaps*: bit ``i`` of a class tells whether it
has an odd number of shingles whose hash ends in ``i``.  Bits that differ are shingles that only
one of the two has, so their number bounds the intersection from above and no link is lost; a
bitmap is about a sixtieth of the set.  Only pairs that pass are verified on whole sets, in two
rounds:

1. leaders: every class with its group's leader, every group with its best partner, and in a
   bucket of more than ``BUCKET`` groups every group with the one whose prefix reaches the
   bucket's shingle first;
2. the rest: every other pair of classes that the links of round 1 have not already joined, in
   pairs where few groups share a shingle, in square blocks where many do.  A pair of one
   component cannot change the components.  A block in which more pairs pass than a bound is
   compared on whole sets as it is, so pairs are never written out by the square.

So the components are exact, whatever the sizes of buckets and groups, and a group of near
copies costs a number of comparisons in proportion to its size as long as its members join.
A shingle is known by 64 bits of a hash and equal sets by 128, without a further check.

Definitions for odd rows: null and empty texts have an empty set and no links; a null id is
returned with a null component and takes no part; rows that repeat an id are one document of
the graph, with the links of each of its texts; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textblock as tb
from quern.llm.components import connected_components
from quern.sources.workspace import Workspace

#: Groups in a bucket that are compared pair by pair in round 1.
BUCKET = 24
#: Rows and shingles on each side of a block of a family, about.
SIDE = 1024
SIDE_SHINGLES = 1 << 20
#: A block with more passing pairs for each of its rows than this is compared on whole sets.
DENSE = 8
#: Two groups with more pairs of members than this are compared in blocks.
WIDE = 1024
#: A shingle in more prefixes than this comes last in the order.
COMMON = 24
#: Shingles of that kind that are sent to the workers (8 bytes each); any choice is right.
MOST_COMMON = 1_000_000
#: Ids of documents to verify that are sent to the texts; beyond it the texts move to the ids.
BROADCAST_IDS = 1_000_000
#: Bits of a bitmap, at least and at most; powers of two.
BITS = (64, 8192)


def prefix_size(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    return int(np.bitwise_xor.reduce(tb.mix(s))) if len(s) else 0, int(tb.mix(s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64))


def _list(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def parity(s: np.ndarray) -> bytes:
    """The parity bitmap of a set of hashes; its size is the power of two from the set's size on."""
    bits = min(max(BITS[0], 1 << max(0, len(s) - 1).bit_length()), BITS[1])
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bitmaps at a smaller width: a smaller modulus joins halves."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _may_link(nx: np.ndarray, ny: np.ndarray, differ: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of these sizes that differ in so many shingles, at least, can be linked."""
    both = np.minimum((nx + ny - differ) // 2, np.minimum(nx, ny))
    return t.denominator * both >= t.numerator * (nx + ny - both)


KINDS = "id long, n int, s1 long, s2 long, g1 long, g2 long, bits binary, prefix array<long>"


def _prefixes(k: int, t: Fraction, common):
    """Id, set size, signatures of set and prefix, bitmap and prefix of every text; a block of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value if common is not None else np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for row, raw, off in tb.blocks(batch.column(1)):
                numbers, bitmaps, prefixes = [], [], []
                for s in tb.shingles(*tb.words(raw, off), k):
                    n = len(s)
                    if n == 0:
                        numbers.append((0, 0, 0, 0, 0))
                        bitmaps.append(b"")
                        prefixes.append(s)
                        continue
                    one, two = _signature(s)
                    bitmaps.append(parity(s) if common is not None else b"")
                    p = prefix_size(n, t)
                    if len(last):
                        at = np.searchsorted(last, s)
                        at[at == len(last)] = 0
                        late = last[at] == s
                        s = np.concatenate([s[~late], s[late]]) if late[:p].any() else s
                    prefixes.append(s[:p])
                    key = np.frombuffer(hashlib.blake2b(s[:p].tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest(), dtype=np.uint64)
                    numbers.append((n, one, two, int(key[0]), int(key[1])))
                n, *keys = np.array(numbers, dtype=np.uint64).reshape(-1, 5).T
                columns = [batch.column(0).slice(row, len(off) - 1), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bitmaps, pa.binary()), _list(prefixes)], names=["id", "n", "s1", "s2", "g1", "g2", "bits", "prefix"])

    return run


def _needed(nx: np.ndarray, ny: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest intersection of sets of these sizes with Jaccard ``t``."""
    return -(-t.numerator * (nx + ny) // (t.numerator + t.denominator))


def _reach(nx, ix, ny, iy, t: Fraction) -> np.ndarray:
    """Pairs whose sizes and positions of a common shingle still allow a link."""
    least = _needed(nx, ny, t)
    sizes = (np.minimum(nx, ny) * t.denominator) >= (np.maximum(nx, ny) * t.numerator)
    return sizes & (np.minimum(nx - ix, ny - iy) + np.minimum(ix, iy) >= least)


def _bucket_pairs(t: Fraction, bucket: int):
    """Pairs of groups from rows ``w, pn, g`` sorted by shingle, position and group (pn: position and size in one number).

    Kind 0 is a pair of a small bucket, kind 1 a group of a large bucket with its leader (the
    first row), kind 2 a row of a large bucket itself (b = its leader).
    Buckets may span batches; a large one is never held.
    """

    def pairs(w, g, n, pos) -> Iterator[tuple]:
        """Of complete buckets of at most bucket rows, all of one size at a time."""
        edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        size = np.diff(edge)
        for m in range(2, bucket + 1):
            at = edge[:-1][size == m]
            if not len(at):
                continue
            i, j = np.triu_indices(m, 1)
            step = max(1, 2_000_000 // len(i))
            for c in range(0, len(at), step):
                x, y = (at[c : c + step, None] + i).ravel(), (at[c : c + step, None] + j).ravel()
                ok = _reach(n[x], pos[x], n[y], pos[y], t) & (g[x] != g[y])
                x, y = x[ok], y[ok]
                yield np.minimum(g[x], g[y]), np.maximum(g[x], g[y]), np.where(g[x] < g[y], n[x], n[y]), np.where(g[x] < g[y], n[y], n[x]), np.zeros(len(x), dtype=np.int32), 0

    def large(w, g, n, pos, lead) -> Iterator[tuple]:
        ok = g != lead[1]
        a, b = np.minimum(g, lead[1])[ok], np.maximum(g, lead[1])[ok]
        sizes = (np.minimum(n, lead[2]) * t.denominator >= np.maximum(n, lead[2]) * t.numerator)[ok]
        zero = np.zeros(int(sizes.sum()), dtype=np.int32)
        yield a[sizes], b[sizes], zero, zero, zero, 1
        yield g, np.full(len(g), lead[1]), n, np.zeros(len(g), dtype=np.int32), pos, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, lead = None, None

        def out(found):
            for a, b, na, nb, pos, kind in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(a), kind, dtype=np.int32))], names=["a", "b", "na", "nb", "pos", "kind"])

        def take(cols, final):
            nonlocal carry, lead
            w, g, n, pos = cols
            if lead is not None:
                end = int(np.argmax(w != lead[0])) if (w != lead[0]).any() else len(w)
                yield from out(large(w[:end], g[:end], n[:end], pos[:end], lead))
                w, g, n, pos = w[end:], g[end:], n[end:], pos[end:]
                if not len(w):
                    carry = None
                    return
                lead = None
            edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
            size = np.diff(edge)
            whole = len(size) if final else len(size) - 1
            for b in np.flatnonzero(size[:whole] > bucket):
                s = slice(edge[b], edge[b + 1])
                yield from out(large(w[s], g[s], n[s], pos[s], (w[s][0], g[s][0], n[s][0])))
            small = np.repeat((size > 1) & (size <= bucket) & (np.arange(len(size)) < whole), size)
            if small.any():
                yield from out(pairs(w[small], g[small], n[small], pos[small]))
            carry = None
            if not final:
                s = slice(edge[-2], edge[-1])
                if size[-1] > bucket:
                    lead = (w[s][0], g[s][0], n[s][0])
                    yield from out(large(w[s], g[s], n[s], pos[s], lead))
                else:
                    carry = (w[s], g[s], n[s], pos[s])

        for batch in batches:
            if not batch.num_rows:
                continue
            w, pn, g = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cols = (w, g, pn & 0xFFFFFFFF, pn >> 32)
            if carry is not None:
                cols = tuple(np.concatenate(x) for x in zip(carry, cols, strict=True))
            yield from take(cols, False)
        if carry is not None:
            yield from take(carry, True)

    return run


def _set_rows(k: int):
    """Id and the set of every text that has words, as bytes of sorted hashes; a block of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, off in tb.blocks(batch.column(1)):
                sets = [s.tobytes() for s in tb.shingles(*tb.words(raw, off), k)]
                ids = batch.column(0).slice(row, len(off) - 1)
                for at in range(0, len(sets), 256):  # a set may have four times the bytes of its text
                    some = pa.array(sets[at : at + 256], pa.binary())
                    told = pc.greater(pc.binary_length(some), 0)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, 256).filter(told), some.filter(told)], names=["id", "set"])

    return run


def _bit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a binary column."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int32, count=len(column) + 1, offset=column.offset * 4).astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), off[:-1], np.diff(off)


def _likely(t: Fraction):
    """Of pairs with sizes and bitmaps those that may be links: the columns before these four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, nx, ny, x, y = batch.columns
            keep = np.zeros(batch.num_rows, dtype=bool)
            nx, ny = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (nx, ny))
            (x, x_at, x_size), (y, y_at, y_size) = _bit_rows(x), _bit_rows(y)
            for w, v in set(zip(x_size.tolist(), y_size.tolist(), strict=True)):
                rows = np.flatnonzero((x_size == w) & (y_size == v))
                for at in range(0, len(rows), 4096):
                    r = rows[at : at + 4096]
                    p, q = x[x_at[r][:, None] + np.arange(w)], y[y_at[r][:, None] + np.arange(v)]
                    differ = np.bitwise_count(_folded(p, min(w, v)) ^ _folded(q, min(w, v))).sum(axis=1, dtype=np.int64)
                    keep[r] = _may_link(nx[r], ny[r], differ, t)
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names[:-4]).filter(pa.array(keep))

    return run


def _linked(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(t.denominator * both >= t.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _block_links(t: Fraction):
    """Pairs of different labels with a link between the left and the right rows of a block."""

    def run(table: pa.Table) -> pa.Table:
        x, y = _sides(table)
        label = table["l"].to_numpy()
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["set"]]
        size = np.array([len(v) for v in sets])
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left, right = np.zeros(len(sets), dtype=bool), np.zeros(len(sets), dtype=bool)
        left[x], right[y] = True, True
        word, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        # only shingles that both sides hold can be in an intersection
        of_left, of_right = np.repeat(left, size), np.repeat(right, size)
        both = (np.bincount(at[of_left], minlength=len(word)) > 0) & (np.bincount(at[of_right], minlength=len(word)) > 0)
        column = np.cumsum(both) - 1
        keep = both[at]
        row, at, of_left, of_right = row[keep], column[at[keep]], of_left[keep], of_right[keep]
        place_x, place_y = np.cumsum(left) - 1, np.cumsum(right) - 1
        common = np.zeros((len(x), len(y)), dtype=np.float32)
        step = 8192
        for c in range(0, int(both.sum()), step):
            here = (at >= c) & (at < c + step)
            a, b = np.zeros((len(x), step), dtype=np.float32), np.zeros((len(y), step), dtype=np.float32)
            a[place_x[row[here & of_left]], at[here & of_left] - c] = 1
            b[place_y[row[here & of_right]], at[here & of_right] - c] = 1
            common += a @ b.T
        common = common.astype(np.int64)
        linked = (t.denominator * common >= t.numerator * (size[x][:, None] + size[y][None, :] - common)) & (label[x][:, None] != label[y][None, :])
        i, j = np.nonzero(linked)
        pairs = np.unique(np.column_stack([np.minimum(label[x][i], label[y][j]), np.maximum(label[x][i], label[y][j])]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


KEYS = ["kind", "f", "e", "i", "j"]
BLOCK = "a long, b long, kind int, f long, e long, i int, j int"


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block's left and right side; a family of one block has its odd rows on the left."""
    left, odd = table["left"].to_numpy(), table["odd"].to_numpy()
    if not left.any():
        return np.flatnonzero(odd), np.arange(len(odd))
    return np.flatnonzero(left), np.flatnonzero(~left)


def _block_pairs(t: Fraction, dense: float):
    """Pairs of classes of different labels that may be links, or the block's key alone where they are too many."""

    def run(table: pa.Table) -> pa.Table:
        x, y = _sides(table)
        label, ids, n = (table[c].to_numpy() for c in ("l", "c", "n"))
        data, at, size = _bit_rows(table["bits"].combine_chunks())
        found, many = [], 0
        for w in np.unique(size[x]):
            for v in np.unique(size[y]):
                p, q, width = x[size[x] == w], y[size[y] == v], int(min(w, v))
                unpacked = lambda r, own: np.unpackbits(_folded(data[at[r][:, None] + np.arange(own)], width), axis=1).astype(np.float32)  # noqa: B023, E731
                left, right = unpacked(p, w), unpacked(q, v)
                for c in range(0, len(p), 256):
                    own, some = left[c : c + 256], p[c : c + 256]
                    differ = (own.sum(axis=1)[:, None] + right.sum(axis=1)[None, :] - 2 * (own @ right.T)).astype(np.int64)
                    may = _may_link(n[some][:, None].astype(np.int64), n[q][None, :].astype(np.int64), differ, t) & (label[some][:, None] != label[q][None, :])
                    i, j = np.nonzero(may)
                    many += len(i)
                    if many > dense * len(ids):
                        key = {k: table[k].combine_chunks()[:1] for k in KEYS}
                        return pa.table({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), **key})
                    found.append(np.column_stack([ids[some][i], ids[q][j]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        none = {k: pa.nulls(len(pairs), table[k].type) for k in KEYS}
        return pa.table({"a": pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]), "b": pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 1]), **none})

    return run


class JaccardJoin:
    """Components of the graph that links documents of Jaccard ``threshold`` or more.

    ``threshold`` is a fraction, so that no set is judged by a rounded product.
    """

    def __init__(self, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, common: int = COMMON, dense: float = DENSE, wide: int = WIDE, broadcast_ids: int = BROADCAST_IDS) -> None:
        self.k, self.t, self.id_col, self.text_col = k, Fraction(threshold), id_col, text_col
        # limits choose between ways to the same result
        self.bucket, self.common, self.dense, self.wide, self.broadcast_ids = bucket, common, dense, wide, broadcast_ids

    def _sets(self, docs: DataFrame, nodes: DataFrame, ws: Workspace, name: str) -> DataFrame:
        """``(id, set)`` of the texts of ``nodes(id)``: the ids go to the texts if they are few, else the texts to the ids."""
        nodes = ws.save(nodes.distinct(), f"{name}-ids")
        few = nodes.count() <= self.broadcast_ids
        texts = docs.join(F.broadcast(nodes) if few else nodes, "id", "left_semi")
        return ws.save(texts.mapInArrow(_set_rows(self.k), "id long, set binary").distinct(), f"{name}-sets")

    def _verify(self, pairs: DataFrame, docs: DataFrame, ws: Workspace, name: str) -> DataFrame:
        """The pairs (distinct) that are links, by their whole sets."""
        pairs = ws.save(pairs, f"{name}-pairs")
        sets = self._sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), ws, name)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        links = ws.save(both.select("a", "b", "x", "y").mapInArrow(_linked(self.t), "a long, b long"), f"{name}-links")
        ws.drop(f"{name}-sets", f"{name}-ids", f"{name}-pairs")
        return links

    def _pass(self, pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
        """Rows of ``pairs(a, b, ...)`` that may be links by their bitmaps."""
        x, y = (bitmaps.select(F.col("c").alias(s), F.col("n").alias(f"_n{s}"), F.col("bits").alias(f"_bits{s}")) for s in "ab")
        both = pairs.join(x, "a").join(y, "b").select(*pairs.columns, "_na", "_nb", "_bitsa", "_bitsb")
        return both.mapInArrow(_likely(self.t), pairs.schema)

    def _families(self, sources: list[DataFrame], bitmaps: DataFrame, done: DataFrame, docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
        """Pairs that may be links between the labels of a family, and links found already.

        A family is a group, or all groups in large buckets of one leader, or two large groups;
        ``sources`` give ``kind, f, e, c, l, n``.  Of a link between two labels one end, at
        least, is not of the family's main label; those are compared with all others in square
        blocks, by their bitmaps.
        """
        rows = sources[0]
        for more in sources[1:]:
            rows = rows.unionByName(more)
        key = KEYS[:3]
        labels = rows.groupBy(*key, "l").agg(F.count("*").alias("count"), F.sum("n").alias("size"))
        most = F.struct("count", "l")
        mixed = labels.groupBy(*key).agg(F.max_by("l", most).alias("most"), F.max("count").alias("main"), F.max_by("size", most).alias("main_size"), F.sum("count").alias("all"), F.sum("size").alias("all_size")).where("main < all")
        side = lambda n, m: F.greatest(F.ceil(n / F.lit(SIDE)), F.ceil(m / F.lit(SIDE_SHINGLES)), F.lit(1)).cast("int")
        rows = rows.join(mixed, key).withColumn("rows", side(F.col("all"), F.col("all_size"))).withColumn("columns", side(F.col("all") - F.col("main"), F.col("all_size") - F.col("main_size")))
        rows = ws.save(rows.select(*key, "c", "l", (F.col("l") != F.col("most")).alias("odd"), "rows", "columns"), "mixed")
        spread = F.xxhash64("c")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # a family of one block goes there once, its odd rows being the left side
        left = rows.where("odd AND rows + columns > 2").withColumn("i", F.pmod(spread, F.col("columns")).cast("int")).withColumn("j", every("rows")).withColumn("left", F.lit(True))
        right = rows.withColumn("j", F.pmod(spread, F.col("rows")).cast("int")).withColumn("i", every("columns")).withColumn("left", F.lit(False))
        columns = [*KEYS, "c", "l", "odd", "left"]
        placed = left.select(*columns).unionByName(right.select(*columns))
        found = ws.save(placed.join(bitmaps, "c").groupBy(*KEYS).applyInArrow(_block_pairs(self.t, self.dense), BLOCK), "block-pairs")
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
        dense = found.where("a IS NULL").select(*KEYS)
        if dense.isEmpty():
            return pairs, docs.sparkSession.createDataFrame([], "a long, b long")
        placed = ws.save(placed.join(dense, KEYS), "dense")
        sets = self._sets(docs, placed.select(F.col("c").alias("id")), ws, "family")
        filled = placed.join(sets, F.col("c") == F.col("id")).select(*KEYS, "l", "odd", "left", "set")
        links = ws.save(filled.groupBy(*KEYS).applyInArrow(_block_links(self.t), "a long, b long").distinct(), "family-links")
        ws.drop("family-sets", "family-ids", "dense")
        return pairs, links

    def components(self, documents: DataFrame, ws: Workspace) -> DataFrame:
        """``(doc_id, n_shingles, component_id)``, one row for every row of ``documents``."""
        spark, t = documents.sparkSession, self.t
        docs = documents.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).alias("text"))

        # which shingles are in many prefixes, over all documents
        first = docs.mapInArrow(_prefixes(self.k, t, None), KINDS).select(F.explode("prefix").alias("w"))
        counted = first.groupBy("w").count().where(F.col("count") > self.common)
        hot = counted.orderBy(F.desc("count"), "w").limit(MOST_COMMON).toArrow()["w"].to_numpy()
        hot = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))

        made = ws.save(docs.mapInArrow(_prefixes(self.k, t, hot), KINDS), "made")
        # one row for each class; all but the id follows from the set
        rest = [F.first(c).alias(c) for c in ("n", "g1", "g2", "bits", "prefix")]
        classes = ws.save(made.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("c"), *rest), "classes")
        every = ws.save(made.select("id", "n", "s1", "s2"), "every")
        ws.drop("made")
        groups = classes.groupBy("g1", "g2").agg(F.min("c").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        number = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
        buckets = groups.select("g", "n", F.posexplode("prefix").alias("pos", "w")).select("w", number.alias("pn"), "g")
        found = ws.save(buckets.repartition("w").sortWithinPartitions("w", "pn", "g").mapInArrow(_bucket_pairs(t, self.bucket), "a long, b long, na int, nb int, pos int, kind int"), "found")
        names = classes.groupBy("g1", "g2").agg(F.min("c").alias("g"))
        members = ws.save(classes.select("c", "n", "g1", "g2").join(names, ["g1", "g2"]).select("c", "g", "n").distinct(), "members")
        bitmaps = ws.save(classes.select("c", "n", "bits"), "bitmaps")
        classes = ws.save(classes.select("s1", "s2", "c"), "named-classes")
        ws.drop("classes")

        # a pair needs enough prefix shingles in common: the rest of either set is all it can add
        rest = lambda n: F.ceil(F.col(n).cast("long") * t.numerator / t.denominator) - 1
        least = F.ceil((F.col("na").cast("long") + F.col("nb")) * t.numerator / (t.numerator + t.denominator))
        small = found.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        # prefix shingles in large buckets are not in that count: at most as many as either has there
        in_large = found.where("kind = 2").groupBy("a").count()
        for side in "ab":
            small = small.join(in_large.select(F.col("a").alias(side), F.col("count").alias(f"l{side}")), side, "left")
        common = F.col("c") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
        # one unit of slack: divisions above are in double precision
        small = ws.save(small.where(common + F.greatest(rest("na"), rest("nb")) + 1 >= least).groupBy("a", "b").agg(F.max("c").alias("c")), "small")

        stars = found.where("kind = 1").select("a", "b").unionByName(members.where("c <> g").select(F.col("g").alias("a"), F.col("c").alias("b")))
        leaders = small.select("a", "b", "c", F.lit(0).alias("star")).unionByName(stars.distinct().select("a", "b", F.lit(0).cast("long").alias("c"), F.lit(1).alias("star")))
        likely = ws.save(self._pass(leaders.groupBy("a", "b").agg(F.max("c").alias("c"), F.max("star").alias("star")), bitmaps).groupBy("a", "b").agg(F.max("c").alias("c"), F.max("star").alias("star")), "likely")
        best = likely.where("c > 0").groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
        round1 = ws.save(best.unionByName(likely.where("star = 1").select("a", "b")).distinct(), "round1")
        links1 = self._verify(round1, docs, ws, "one")
        # an id with several texts holds their classes together
        of_doc = ws.save(every.where("n > 0 AND id IS NOT NULL").select("id", "s1", "s2").join(classes, ["s1", "s2"]).select("id", "c"), "of_doc")
        several = of_doc.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("id")
        links1 = links1.unionByName(of_doc.join(several, "id").select(F.col("id").alias("a"), F.col("c").alias("b")))
        label = connected_components(links1, ws, "cc1")

        # what round 1 left: classes of different labels in one family or in a pair of groups
        named = ws.save(members.join(label.withColumnRenamed("id", "c"), "c", "left").select("c", "g", "n", F.coalesce("component", "c").alias("l")), "named")
        of_group = ws.save(named.groupBy("g").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("m")), "of_group")
        la, lb = (of_group.select(F.col("g").alias(s), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"), F.col("m").alias(f"m{s}")) for s in "ab")
        early = ws.save(small.select("a", "b").join(la, "a").join(lb, "b").where("NOT (loa = hia AND lob = hib AND loa = lob)").select("a", "b", (F.col("ma") * F.col("mb") <= self.wide).alias("few")), "early")
        ma, mb = (named.select(F.col("g").alias(s), F.col("c").alias(f"c{s}"), F.col("l").alias(f"l{s}")) for s in "ab")
        wide = early.where("few").join(ma, "a").join(mb, "b").where("la <> lb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        wide = ws.save(self._pass(wide.join(round1, ["a", "b"], "left_anti"), bitmaps).distinct(), "wide")
        of = lambda rows, kind, f, e: rows.join(named, "g").select(F.lit(kind).alias("kind"), f.alias("f"), e.alias("e"), "c", "l", "n")
        own, none = F.col("g"), F.lit(0).cast("long")
        two = early.where("NOT few").select("a", "b", F.explode(F.array("a", "b")).alias("g"))
        sources = [of(found.where("kind = 2").select(F.col("b").alias("f"), F.col("a").alias("g")).distinct(), 0, F.col("f"), none), of(of_group.where("lo <> hi").select("g"), 1, own, none), of(two, 2, F.col("a"), F.col("b"))]
        pairs, links2 = self._families(sources, bitmaps, round1, docs, ws)
        links2 = links2.unionByName(self._verify(wide.unionByName(pairs).distinct(), docs, ws, "two"))
        final = connected_components(links1.unionByName(links2), ws, "cc2")
        ws.drop("found", "small", "members", "bitmaps", "likely", "named", "of_group", "mixed", "early", "wide", "round1", "block-pairs")

        result = every.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").join(final.withColumnRenamed("id", "c"), "c", "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.when(F.col("n") > 0, F.col("c")), "id"))
        return result.select(F.col("id").alias(self.id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component at three words and Jaccard 0.9."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return JaccardJoin(3, Fraction(9, 10)).components(documents, Workspace(spark, "jaccard"))

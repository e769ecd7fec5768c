"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary text.

Each class has an interpolated Kneser-Ney model of word pairs.  A pair's count is the number of
distinct words before it, a word's count that of distinct words before it, so copies of a text
count once.  What a class discounts from a context goes to that class's word counts, and what it
discounts from those to counts of words over all documents, which both classes share: an
expression that is rare in both has the same probability in both but for the discounted mass.

Runs of words are counted by a distributed aggregation over all labelled rows outside the
held-out fold, the shared counts over all documents; only the curve is fitted on a bounded
sample.  The evidence of a document is one number: the log-likelihood ratio per word of its worst
stretch of ``WINDOW`` words.  A logistic curve of that number, fitted on labelled rows that the
models have not seen, maps it to 0..1.

Null and empty texts have evidence 0.  Repeated rows are scored alike; a labelled id that repeats
counts with each of its texts, an id labelled more than once with its largest label; null ids have
no label.  Without labelled rows of both kinds every document gets the share of label 1 (0 without
labels).  An empty table gives an empty result; other columns, whatever their names, stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textblock as tb
from quern.llm.labelled import logistic, remainder, sigmoid, training_labels
from quern.sources.workspace import Workspace

#: Chosen by four-fold cross-validation inside the training fold of sf0.1 (see the README).
WINDOW = 2
WORD_DISCOUNT = 3.0
PAIR_DISCOUNT = 8.0
#: Documents of each class that the curve is fitted on, at most.
PER_CLASS = 750
#: Words that a task gathers before it packs their runs.
FLUSH = 2_000_000
#: Runs of a bucket that a task merges at once.
RUNS = 1_000_000
#: Labelled rows that are sent to the documents rather than the documents to them.
BROADCAST_ROWS = 2_000_000
#: Roles of ordinary and of toxic rows, without and with those held back for the curve.
VARIANTS = (((0,), (1,)), ((0, 2), (1, 3)))
_START = np.uint64(0x5CA1AB1E)
_U = np.uint64


def _pair(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return tb.mix(prev * _U(0x9E3779B97F4A7C15) + cur)


def _find(keys: np.ndarray, values: np.ndarray, probe: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return np.full(len(probe), missing), np.zeros(len(probe), dtype=bool)
    at = np.searchsorted(keys, probe)
    at[at == len(keys)] = 0
    hit = keys[at] == probe
    return np.where(hit, values[at], missing), hit


@dataclass
class KneserNeyPair:
    """Sorted tables of log-ratios: of kept pairs; else a context's part and a word's part are added.

    A context without a row has part 0, a word without one ``unknown``: the ratio of what the
    classes discount.
    """

    pairs: np.ndarray
    pair_llr: np.ndarray
    contexts: np.ndarray
    context_llr: np.ndarray
    words: np.ndarray
    word_llr: np.ndarray
    unknown: float
    curve: np.ndarray  # of [ratio, intercept]

    def ratios(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-ratio of each word after the one before it."""
        prev = np.empty_like(word)
        prev[1:] = word[:-1]
        prev[at[:-1][np.diff(at) > 0]] = _START
        llr, hit = _find(self.pairs, self.pair_llr, _pair(prev, word), 0.0)
        miss = np.flatnonzero(~hit)
        llr[miss] = _find(self.words, self.word_llr, word[miss], self.unknown)[0] + _find(self.contexts, self.context_llr, prev[miss], 0.0)[0]
        return llr

    def evidence(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each row the ratio per word of its worst window; 0 without words."""
        n = np.diff(at)
        out = np.zeros(len(n))
        if len(word) == 0:
            return out
        full = n > 0
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(word, at))])
        ends = np.repeat(at[1:][full], n[full])
        first = np.repeat(at[:-1][full], n[full])
        here = np.arange(at[0], at[-1])
        stop = np.minimum(here + WINDOW, ends)
        begin = np.maximum(np.minimum(here, stop - WINDOW), first)
        out[full] = np.maximum.reduceat((sums[stop] - sums[begin]) / (stop - begin), at[:-1][full] - at[0])
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(evidence * self.curve[0] + self.curve[1])


def _pack(ids: list[np.ndarray], names: np.ndarray, flags: np.ndarray) -> bytes:
    """Columns of word numbers (frequent words have small ones) with the hashes that they stand for."""
    used = np.zeros(len(names), dtype=bool)
    for c in ids:
        used[c] = True
    place = np.cumsum(used) - 1
    own = np.stack([place[c] for c in ids]).astype("<u4")
    planes = np.ascontiguousarray(own.view(np.uint8).reshape(len(ids), -1, 4).transpose(0, 2, 1))
    hashes = names[used]
    head = np.array([len(flags), len(hashes)], dtype="<i8")
    return head.tobytes() + hashes.tobytes() + planes.tobytes() + flags.tobytes()


def _unpack(raw: bytes, columns: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, ...]:
    """Columns of words and the roles' bits; of several parts, which the first column decides, one."""
    n, used = (int(x) for x in np.frombuffer(raw, dtype="<i8", count=2))
    names = np.frombuffer(raw, dtype=np.uint64, count=used, offset=16)
    planes = np.frombuffer(raw, dtype=np.uint8, count=columns * 4 * n, offset=16 + 8 * used).reshape(columns, 4, n)
    flags = np.frombuffer(raw, dtype=np.uint8, offset=16 + 8 * used + 4 * columns * n)
    number = lambda c, rows: np.ascontiguousarray(planes[c][:, rows].T).view("<u4").ravel()
    own = slice(None)
    if parts > 1:
        # the upper half, since buckets are dealt by the remainder
        own = np.flatnonzero(((tb.mix(names) >> _U(32)) % _U(parts) == part)[number(0, slice(None))])
    return *(names[number(c, own)] for c in range(columns)), flags[own]


def _before(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def _runs(buckets: int, triples: bool, flush: int = FLUSH):
    """Distinct runs of words of each ``flush`` words, with one bit for each role that has them.

    Pairs are (word, previous) and dealt by the word, triples (previous, word, the one before
    both) and dealt by the previous.
    """

    def distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Columns of word numbers, the hashes that they stand for, bits; empties ``parts``."""
        first, bit = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
        found = pa.concat_arrays([*(pa.array(x[0]) for x in parts), pa.array([_START], pa.uint64())]).dictionary_encode()
        parts.clear()
        names, inverse = found.dictionary.to_numpy(), found.indices.to_numpy()
        del found
        by_count = np.argsort(-np.bincount(inverse), kind="stable")
        rank = np.empty(len(names), dtype=np.uint32)
        rank[by_count] = np.arange(len(names), dtype=np.uint32)
        cur, start = rank[inverse[:-1]], rank[inverse[-1]]
        del inverse
        prev = _before(cur, first, start)
        columns = [prev, cur, _before(prev, first, start)] if triples else [cur, prev]
        del cur, prev, first
        bits = len(names).bit_length()
        if len(columns) * bits <= 63:
            key = columns.pop(0).astype(np.uint64)
            n = len(columns)
            while columns:
                key <<= _U(bits)
                key |= columns.pop(0)
            order = np.argsort(key)
            key, bit = key[order], bit[order]
            del order
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            key = key[new]
            columns = [(key >> _U(i * bits) & _U((1 << bits) - 1)).astype(np.uint32) for i in range(n, -1, -1)]
        else:
            order = np.lexsort(columns[::-1])
            columns, bit = [c[order] for c in columns], bit[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            columns = [c[new] for c in columns]
        return columns, names[by_count], np.bitwise_or.reduceat(bit, np.flatnonzero(new))

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
        columns, names, flags = distinct(parts)
        bucket = (tb.mix(names) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)[columns[0]]
        order = np.argsort(bucket, kind="stable")
        here, at = np.unique(bucket[order], return_index=True)
        del bucket
        for b, rows in zip(here.tolist(), np.split(order, at[1:]), strict=True):
            yield b, _pack([c[rows] for c in columns], names, flags[rows])

    def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        codec = pa.Codec("zstd")
        rows = [(b, len(x), codec.compress(x, asbytes=True)) for b, x in packed(parts)]
        kinds = {"bucket": pa.int32(), "size": pa.int64(), "runs": pa.binary()}
        return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for texts in batches:
            roles = texts["role"].fill_null(-1).to_numpy(zero_copy_only=False)
            bits = np.where(roles >= 0, 1 << np.maximum(roles, 0), 0).astype(np.uint8)
            for row, raw, off in tb.blocks(texts["text"]):
                word, at = tb.words(raw, off, tb.ALNUM)
                if len(word) == 0:
                    continue
                first = np.zeros(len(word), dtype=bool)
                first[at[:-1][np.diff(at) > 0]] = True
                parts.append((word, first, np.repeat(bits[row : row + len(off) - 1], np.diff(at))))
                held += len(word)
                if held >= flush:
                    yield batch(parts)
                    held = 0
        if parts:
            yield batch(parts)

    return gather


def _unpacked(table: pa.Table, columns: int, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of words and the roles' bits of each packed row."""
    codec = pa.Codec("zstd")
    for size, runs in zip(table["size"].to_pylist(), table["runs"], strict=True):
        yield _unpack(codec.decompress(runs.as_buffer(), size, asbytes=True), columns, part, parts)


def _parts(table: pa.Table, columns: int) -> int:
    """Passes over a bucket, each of about ``RUNS`` runs; the words of a run's first column are in one."""
    return max(1, -(-sum(table["size"].to_pylist()) // ((4 * columns + 1) * RUNS)))


def _merged(key: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct key, in the order of keys, and the bits of all that are equal."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[first], np.bitwise_or.reduceat(flags[order], first)


TOLD = "variant int, pair long, context long, word long, own0 double, own1 double, fall0 double, fall1 double"


def _told(discount: float):
    """Of one bucket of triples the pairs that are left in a class after discounting, for both variants.

    ``own`` is what is left of a pair in its context, ``fall`` what the class discounts from it.
    """

    def tell_part(table: pa.Table, part: int, parts: int) -> Iterator[pa.Table]:
        rows = [(cur, prev, _pair(_pair(older, prev), cur), flags) for prev, cur, older, flags in _unpacked(table, 3, part, parts)]
        cur, prev, triple, flags = (np.concatenate([r[i] for r in rows]) for i in range(4))
        del rows
        if len(triple) == 0:
            return
        first, flags = _merged(triple, flags)  # copies of a text count once
        del triple
        prev, cur = prev[first], cur[first]
        key = _pair(prev, cur)
        order = np.argsort(key)
        key, flags = key[order], flags[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys, prevs, curs = key[start], prev[order[start]], cur[order[start]]
        del key, order, prev, cur, first
        contexts, context_of = np.unique(prevs, return_inverse=True)
        total = lambda x: np.bincount(context_of, weights=x, minlength=len(contexts))[context_of]
        for variant, roles in enumerate(VARIANTS):
            counts = [np.add.reduceat((flags & sum(1 << r for r in own)) > 0, start, dtype=np.float64) for own in roles]  # ordinary, toxic
            left = [np.maximum(x - discount, 0) for x in counts]
            whole = [total(x) for x in counts]
            told = (left[0] + left[1]) > 0
            columns = {"variant": np.full(told.sum(), variant, dtype=np.int32), "pair": keys[told].view(np.int64), "context": prevs[told].view(np.int64), "word": curs[told].view(np.int64)}
            columns |= {f"own{c}": (left[c] / np.maximum(whole[c], 1))[told] for c in (0, 1)}
            columns |= {f"fall{c}": np.where(whole[c] > 0, 1 - total(left[c]) / np.maximum(whole[c], 1), 1.0)[told] for c in (0, 1)}
            yield pa.table(columns)

    def tell(table: pa.Table) -> pa.Table:
        parts = _parts(table, 3)
        return pa.concat_tables(t for part in range(parts) for t in tell_part(table, part, parts))

    return tell


def _followed(discount: float, wanted):
    """Of one bucket of pairs the words that keep some of their counts or are wanted, and sums of all others."""

    def count_part(table: pa.Table, part: int, parts: int) -> Iterator[pa.Table]:
        rows = [(_pair(prev, cur), cur, flags) for cur, prev, flags in _unpacked(table, 2, part, parts)]
        key, cur, flags = (np.concatenate([r[i] for r in rows]) for i in range(3))
        del rows
        if len(key) == 0:
            return
        first, flags = _merged(key, flags)
        del key
        words, word_of, everywhere = np.unique(cur[first], return_inverse=True, return_counts=True)
        del cur, first
        asked = np.isin(words, wanted.value)
        for variant, roles in enumerate(VARIANTS):
            o, t = (np.bincount(word_of, weights=(flags & sum(1 << r for r in own)) > 0, minlength=len(words)).astype(np.int64) for own in roles)
            single = asked | (o > discount) | (t > discount)
            rest, rest_of, n = np.unique(np.stack([o, t], axis=1)[~single], axis=0, return_inverse=True, return_counts=True)
            whole = np.bincount(rest_of.ravel(), weights=everywhere[~single], minlength=len(rest)).astype(np.int64)
            yield pa.table({
                "variant": np.full(single.sum() + len(rest), variant, dtype=np.int32),
                "word": pa.array([*words[single].view(np.int64).tolist(), *[None] * len(rest)], pa.int64()),
                "ordinary": np.concatenate([o[single], rest[:, 0]]),
                "toxic": np.concatenate([t[single], rest[:, 1]]),
                "everywhere": np.concatenate([everywhere[single], whole]),
                "n": np.concatenate([np.ones(single.sum(), dtype=np.int64), n]),
            })

    def count(table: pa.Table) -> pa.Table:
        parts = _parts(table, 2)
        return pa.concat_tables(t for part in range(parts) for t in count_part(table, part, parts))

    return count


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of ``key long, llr float``, by key; 12 bytes a row come to the driver."""
    table = rows.select("key", F.col("llr").cast("float").alias("llr")).toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["llr"].to_numpy()[order]


def _tables(pairs: DataFrame, counts: DataFrame, variant: int, discount: float) -> dict:
    """The model's tables of one variant; of each word, pair and context one number comes to the driver."""
    pairs, counts = (x.where(F.col("variant") == variant) for x in (pairs, counts))
    left = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))
    sums = counts.agg(*(F.sum(F.col("n") * x) for c in ("ordinary", "toxic") for x in (F.col(c).cast("double"), left(c))), F.sum("everywhere").cast("double"), F.sum("n").cast("double")).first()
    total, kept, (every, kinds) = [sums[0] or 0.0, sums[2] or 0.0], [sums[1] or 0.0, sums[3] or 0.0], [x or 0.0 for x in sums[4:]]
    fall = [1 - k / n if n else 1.0 for k, n in zip(kept, total, strict=True)]
    unknown = math.log(fall[1] / fall[0])
    shared = (F.col("everywhere") + 0.5) / F.lit(every + 0.5 * (kinds + 1))
    prob = [left(c) / F.lit(max(1.0, n)) + shared * f for c, n, f in zip(("ordinary", "toxic"), total, fall, strict=True)]
    own = counts.where("word IS NOT NULL").select("word", F.log(prob[1] / prob[0]).alias("llr"), prob[0].alias("p0"), prob[1].alias("p1"))
    joint = [F.col(f"own{c}") + F.col(f"fall{c}") * F.col(f"p{c}") for c in (0, 1)]
    words = _sorted(own.where(F.abs(F.col("llr") - unknown) > 1e-6).select(F.col("word").alias("key"), "llr"))
    kept_pairs = _sorted(pairs.join(own, "word").select(F.col("pair").alias("key"), F.log(joint[1] / joint[0]).alias("llr")))
    contexts = _sorted(pairs.groupBy(F.col("context").alias("key")).agg(F.max(F.log(F.col("fall1") / F.col("fall0"))).alias("llr")))
    return dict(zip(("words", "word_llr", "pairs", "pair_llr", "contexts", "context_llr"), (*words, *kept_pairs, *contexts), strict=True)) | {"unknown": unknown}


def fit_tables(documents: DataFrame, ws: Workspace, word_discount: float = WORD_DISCOUNT, pair_discount: float = PAIR_DISCOUNT, flush: int = FLUSH) -> list[dict]:
    """Both variants' tables from all rows of ``text, role``, counted where the rows are.

    What comes to the driver are the keys and ratios of what is left after discounting.
    """
    buckets = max(16, 3 * documents.rdd.getNumPartitions() // 4)
    rows = "bucket int, size long, runs binary"
    triples = documents.where("role IS NOT NULL").mapInArrow(_runs(buckets, True, flush), rows)
    pairs = ws.save(triples.groupBy("bucket").applyInArrow(_told(pair_discount), TOLD), "pairs")  # triples go before pairs are shuffled
    wanted = documents.sparkSession.sparkContext.broadcast(pairs.select("word").distinct().toArrow()["word"].to_numpy().view(np.uint64))
    followed = documents.mapInArrow(_runs(buckets, False, flush), rows).groupBy("bucket")
    counts = ws.save(followed.applyInArrow(_followed(word_discount, wanted), "variant int, word long, ordinary long, toxic long, everywhere long, n long"), "counts")
    tables = [_tables(pairs, counts, v, word_discount) for v in range(len(VARIANTS))]
    ws.drop("pairs", "counts")
    return tables


def with_roles(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float]:
    """``id, text, role`` of all documents, and the share of label 1.

    Role 0 is ordinary and 1 toxic, 2 and 3 the same held back for the curve: a fourth of each
    class at most, and ``per_class`` documents, the first by a hash of the id.  All others, those
    of the held-out fold too, have none.
    """
    known = training_labels(labels, "toxic")
    share = known.agg(F.avg("_y")).first()[0] or 0.0
    size = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64("_id")
    held = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(min(per_class, size.get(y, 0) // 4)) for y in (0, 1)]
    held = held[0].unionByName(held[1]).select(F.col("_id").alias("_held"))
    few = sum(size.values()) <= BROADCAST_ROWS  # else the texts move to their labels
    roles = known.join(F.broadcast(held), F.col("_id") == F.col("_held"), "left").select("_id", F.when(F.col("_held").isNull(), F.col("_y")).otherwise(F.col("_y") + 2).alias("role"))
    return documents.select("doc_id", "text").join(F.broadcast(roles) if few else roles, F.col("doc_id") == F.col("_id"), "left").select(F.col("doc_id").alias("id"), "text", "role"), share


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> KneserNeyPair:
    """Fit both models on all documents and the curve on a bounded sample.

    The curve is fitted by tables without the held-back documents and weighted back to the
    labels' own shares; the tables that are returned count these documents, too.
    """
    rows, share = with_roles(documents, labels, per_class)
    without, whole = fit_tables(rows, Workspace(documents.sparkSession, "toxicity"))
    prior = np.array([0.0, np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)])
    model = KneserNeyPair(**whole, curve=prior)
    evidence = _column(documents, KneserNeyPair(**without, curve=prior), False)
    # texts of an id that repeats are told apart by a hash, and only the first of them is sent
    held = rows.where("role >= 2").groupBy("id").agg(F.min_by(F.struct("text", "role"), F.xxhash64("text")).alias("r"))
    held = held.select((F.col("r.role") - 2).alias("y"), evidence(F.col("r.text")).alias("e")).collect()
    y = np.array([r["y"] for r in held], dtype=int)
    if len(y) and 0 < y.mean() < 1:
        own = y.mean()
        weight = np.where(y == 1, share / own, (1 - share) / (1 - own))
        order = sorted(range(len(y)), key=lambda i: (held[i]["y"], held[i]["e"]))  # sums in one order
        model.curve = logistic(np.array([[held[i]["e"]] for i in order]), y[order], weight[order], ridge=1e-3)
    return model


def _column(documents: DataFrame, model: KneserNeyPair, scored: bool):
    """A function of a text column: its evidence, or its score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for row, raw, off in tb.blocks(texts):
            found = sent.value.evidence(*tb.words(raw, off, tb.ALNUM))
            out[row : row + len(off) - 1] = sent.value.score(found) if scored else found
        return pa.array(out)

    return of_text


def score_column(documents: DataFrame, model: KneserNeyPair, text: str = "text") -> Column:
    """The probability that ``text`` is toxic, as a column; other columns stay in the JVM."""
    return _column(documents, model, True)(F.col(text))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity: ``doc_id, held_out, score, predicted``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = documents.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), score_column(documents, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

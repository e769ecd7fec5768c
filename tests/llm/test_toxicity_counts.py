"""The distributed tables against counts by sets, odd rows included."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import textblock as tb
from quern.llm import toxicity
from quern.sources.workspace import Workspace


def _hash(words):
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(tb.words(raw, np.array([0, len(raw)]), tb.ALNUM)[0][0])
    return np.array(out, dtype=np.uint64)


def _brute(rows, counted, d1, d2):
    """The ratio of every pair of known words by the definition of the two models, and that of unknown words."""
    triples, every = {0: set(), 1: set()}, set()
    for text, role in rows:
        prev, older = "<", "<"
        for w in (text or "").split():
            every.add((prev, w))
            if role in counted:
                triples[role % 2].add((older, prev, w))
            older, prev = prev, w
    follow = Counter(w for _, w in every)
    shared = lambda w: (follow[w] + 0.5) / (len(every) + 0.5 * (len(follow) + 1))

    def model(c):
        pair = Counter((p, w) for _, p, w in triples[c])
        before = Counter(w for _, w in pair)
        n = sum(before.values())
        back = sum(min(x, d1) for x in before.values()) / n if n else 1.0
        single = lambda w: max(before[w] - d1, 0) / max(n, 1) + back * shared(w)

        def of(p, w):
            own = {k: x for k, x in pair.items() if k[0] == p}
            m = sum(own.values())
            if not m:
                return single(w)
            return max(pair[p, w] - d2, 0) / m + sum(min(x, d2) for x in own.values()) / m * single(w)

        return of, back

    (ordinary, back0), (toxic, back1) = model(0), model(1)
    vocab = sorted(follow)
    return {(p, w): math.log(toxic(p, w) / ordinary(p, w)) for p in ["<", *vocab] for w in vocab}, math.log(back1 / back0)


@pytest.mark.parametrize("flush", [50, 1_500_000])
def test_tables_equal_brute_force(spark, flush):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    rows = [(" ".join(draw.choices(words, weights=range(25, 0, -1), k=draw.randrange(60))), draw.choice([None, 0, 0, 1, 2, 3])) for _ in range(60)]
    rows += [(None, 0), ("", 1), ("w1", 1), (rows[0][0], 1), rows[1], rows[1]]
    got = toxicity.fit_tables(spark.createDataFrame(rows, "text string, role int").repartition(3), Workspace(spark, "test"), 2.0, 2.0, flush)
    for table, counted in zip(got, ((0, 1), (0, 1, 2, 3)), strict=True):
        told, unknown = _brute(rows, counted, 2.0, 2.0)
        model = toxicity.KneserNeyPair(**table, curve=np.zeros(2))
        assert len(model.pairs) > 10 and len(model.contexts) > 3 and model.unknown == pytest.approx(unknown)
        for (p, w), ratio in told.items():
            text = [w] if p == "<" else [p, w]
            assert model.ratios(_hash(text), np.array([0, len(text)]))[-1] == pytest.approx(ratio, abs=1e-5)
        # the worst window by hand
        text = draw.choices(words, k=30)
        at = [told[p, w] for p, w in zip(["<", *text[:-1]], text, strict=True)]
        worst = max(sum(at[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(30 - toxicity.WINDOW + 1))
        assert model.evidence(_hash(text), np.array([0, 0, 30])).tolist() == pytest.approx([0.0, worst], abs=1e-5)


def test_long_rows_count(spark):
    """An expression that only long documents hold."""
    draw = random.Random(9)
    plain = [f"plain{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = draw.choices(plain, k=8)
        docs.append((i, " ".join(words + (["vile"] if toxic else []))))
        labels.append((i, toxic))
    for i in range(400, 440):
        docs.append((i, " ".join(x for _ in range(1200) for x in (*draw.choices(plain, k=8), "longslur"))))
        labels.append((i, 1))
    assert min(len(t) for i, t in docs if i >= 400) > 60_000
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    at = np.searchsorted(model.words, _hash(["longslur"]))
    assert model.words[at] == _hash(["longslur"]) and model.word_llr[at] > 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for d in (docs, docs.limit(0)):
        model = toxicity.fit(d, none)
        assert all(r["p"] < 1e-9 for r in d.select(toxicity.score_column(d, model).alias("p")).collect())

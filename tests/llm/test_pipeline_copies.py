"""The pipeline's copies stage against brute force, with null and repeated ids."""

import random

import corpus_pipeline


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _brute(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = {}
    for r, g in zip(rows, group, strict=True):
        kept.setdefault(g, r)
    return list(kept.values())


def test_one_row_of_each_group(spark):
    draw = random.Random(11)
    text = lambda: " ".join(draw.choices([f"w{i}" for i in range(500)], k=60))
    base = [text() for _ in range(6)]
    near = base[0] + " more"
    rows = [(i + 1, t) for i, t in enumerate(base)]
    rows += [(20, near), (21, base[1]), (None, base[2]), (7, None), (8, ""), (9, "")]
    rows += [(3, base[2])] * 2 + [(4, text())]  # repeated rows, and an id with another text
    alone = text()
    rows += [(None, alone)] * 3 + [(None, ""), (None, ""), (7, None), (30, alone + " x")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.keep_one_copy(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    assert got == sorted(_brute(rows), key=key)
    assert corpus_pipeline.keep_one_copy(spark, docs.limit(0), "").collect() == []

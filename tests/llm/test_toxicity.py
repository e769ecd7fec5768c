"""The toxicity models on small generated corpora."""

import random

from quern.llm import textblock as tb
from quern.llm import toxicity


def _corpus(spark, n_toxic, n_ordinary):
    draw = random.Random(5)
    plain = [f"word{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n_toxic + n_ordinary):
        words = draw.choices(plain, k=30) + [f"some{i % 30}"]
        if i < n_toxic:
            words[10:10] = ["vile", "slur"] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(i < n_toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_few_toxic_labels_keep_the_ordinary_rows(spark):
    docs, labels = _corpus(spark, 15, 300)
    model = toxicity.fit(docs, labels)
    own = [f"some{i}" for i in range(30)]
    raw = "".join(f"{w} " for w in own).encode()
    word, _ = tb.words(tb.np.frombuffer(raw, dtype="uint8"), tb.np.array([0, len(raw)]), tb.ALNUM)
    # each is in some eight ordinary rows, and in few if those are cut to the number of toxic ones
    assert tb.np.isin(word, model.words).sum() >= 0.7 * len(own)
    score = {r["doc_id"]: r["p"] for r in docs.select("doc_id", toxicity.score_column(docs, model).alias("p")).collect()}
    assert all(p >= 0.5 for i, p in score.items() if i < 15)
    assert all(p < 0.5 for i, p in score.items() if i >= 15)

"""The pipeline's stages on a small corpus: what each must keep and drop, odd rows and an empty table."""

import random

import corpus_pipeline
from quern.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, path, docs, labels):
    spark.createDataFrame(docs, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    draw = random.Random(3)
    plain = [f"word{i}" for i in range(120)]
    docs, labels = [], []
    for i in range(160):
        toxic, bad = i % 8 == 0, i % 5 == 1
        words = draw.choices(plain, k=40)
        if toxic:
            words[5:5] = ["vile", "slur"] * 3
        text = " ".join(words) + "." if not bad else "|| $$ 00 " * 40
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000 + i, docs[2 + 5 * i][1] + " more", "en", "src0", 1) for i in range(3)]
    docs += [(None, docs[3][1], "en", None, None), (900, "", None, "src1", 0), (901, None, "en", "src1", 0), (2, docs[2][1], "en", "src2", docs[2][4])]
    _write(spark, tmp_path, docs, labels)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
        if name != "sentencepiece":
            assert now.columns == before.columns and now.exceptAll(before).count() == 0
    known = set(range(160))
    toxic, bad = {i for i in known if i % 8 == 0}, {i for i in known if i % 5 == 1}
    assert not toxic - bad & set(kept["toxicity"]) and len(known - toxic - set(kept["toxicity"])) <= 3
    assert not bad & set(kept["quality_classifier"]) and len((known - bad) & set(kept["toxicity"])) - len(known & set(kept["quality_classifier"])) <= 3
    assert not {1000, 1001, 1002, None} & set(kept["ngram_jaccard_join"]) and kept["ngram_jaccard_join"].count(2) == 1
    # the mixture takes four fifths of the words, less a document for each leaf
    assert 0.6 * len(kept["ngram_jaccard_join"]) <= len(kept["mixing"]) <= 0.9 * len(kept["ngram_jaccard_join"])
    model = pieces.PieceModel(pieces.read_model())
    text = {i: t for i, t, *_ in docs}
    assert all(model.decode(r["ids"]) == (text[r["doc_id"]] or "") for r in now.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept["sentencepiece"])


def test_empty_tables(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

"""From raw documents to tokens: five stages, each of which writes Parquet for the next.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, pieces, quality, toxicity
from quern.llm.jaccard import JaccardJoin
from quern.sources.shipping import ship
from quern.sources.workspace import Workspace

#: Part of the clean corpus' tokens that the mixture takes.
MIXTURE_SHARE = 0.8
THRESHOLD = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney pair does not call toxic."""
    ship(spark)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(docs, model) < THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, corrected by source and language, is at least even."""
    ship(spark)
    training = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", "lang"), Workspace(spark, "quality"), training)
    return scored.where(F.col("quality") >= quality.THRESHOLD).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, Jaccard 0.8) one row, that of the least id (null ids last).

    Rows are told apart by a hash of all their columns, so an id may be null or repeated.  Texts
    without words are copies only where whole rows are equal.
    """
    ship(spark)
    ws = Workspace(spark, "copies")
    rows = docs.withColumn("_row", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))
    found = ws.save(JaccardJoin(5, Fraction(4, 5), "_row").components(rows, ws).select("_row", "component_id").distinct(), "row_groups")
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n"))
    place = F.struct(F.col("_id").isNull(), "_id", "_row")
    known = ws.save(found.join(ids, "_row"), "row_ids")
    least = known.groupBy("component_id").agg(F.min(place)["_row"].alias("_least"))
    copies = known.join(least, "component_id").where("_row <> _least").select("_row")
    again = known.where("_n > 1").select("_row")
    once = rows.join(copies.unionByName(again).distinct(), "_row", "left_anti")
    first = rows.join(again.join(copies, "_row", "left_anti"), "_row", "left_semi").dropDuplicates(["_row"])
    return once.unionByName(first).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by domain, language and source, one epoch at most."""
    ship(spark)
    mixed = mixing.mix(docs, mixing.default_levels(), mixing.default_weights(), Workspace(spark, "mixture"), share=MIXTURE_SHARE, max_epochs=1)
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document: ``doc_id, lang, source, n_tokens, ids``."""
    ship(spark)
    return pieces.encode_rows(docs, pieces.read_model(), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_copy),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Three stages learn or search beyond SQL; tests compare the copies stage and the toxicity counts
#: with brute force, the others not (see the README).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs

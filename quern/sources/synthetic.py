"""Reproducible collections of sequences with queries and truth, made in parallel.

Each base is a hash of the seed, the document and its place.  Of every eight documents the second
is the reverse complement of the first, the third leads with a repeated block, the fourth has 24
unknown bases in its middle, and the others hold the block in their middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import bases as B

BLOCK = "ACGTTGCA" * 4
UNKNOWN = "N" * 24


def _random(seed: int, owner: Column, length: int) -> Column:
    base = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(seed), owner, i), F.lit(4)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "")


def documents(spark: SparkSession, count: int = 64, length: int = 1000, seed: int = 7) -> DataFrame:
    """``document_id, sequence_id, name, sequence``."""
    if count < 1 or length < 2:
        raise ValueError("a collection needs a document of two bases")
    kind = F.col("id") % 8
    half = length // 2
    core = _random(seed, F.when(kind == 1, F.col("id") - 1).otherwise(F.col("id")), length)
    rows = spark.range(count).withColumn("core", core)
    put = lambda x: F.concat(F.substring("core", 1, half), F.lit(x), F.substring("core", half + 1, length))
    text = F.when(kind == 1, B.reverse_complement(put(BLOCK))).when(kind == 2, F.concat(F.lit(BLOCK), "core")).when(kind == 3, put(UNKNOWN)).otherwise(put(BLOCK))
    return rows.select(F.col("id").alias("document_id"), F.col("id").alias("sequence_id"), F.concat(F.lit("doc"), "id").alias("name"), text.alias("sequence"))


def queries(docs: DataFrame, count: int = 64, length: int = 150, seed: int = 7, mutation: float = 0.0) -> DataFrame:
    """``query_id, sequence, expected_document_ids``.

    Every tenth query is unknown bases, with nothing expected; the others are cut from a document,
    which is expected, and its reverse complement with it.  Of every six the fifth is turned to the
    other strand and the sixth has a part ``mutation`` of its bases changed.
    """
    n = docs.count()
    source = docs.select("document_id", F.col("sequence").alias("text"))
    rows = docs.sparkSession.range(count).withColumn("document_id", F.pmod(F.xxhash64(F.lit(seed), F.lit("document"), "id"), F.lit(n))).join(source, "document_id")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "id"), F.greatest(F.length("text") - length + 1, F.lit(1))).cast("int") + 1
    cut = F.translate(F.substring(F.col("text"), start, F.lit(length)), "N", "A")
    place = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit("mutation"), "id", i), F.lit(1_000_000)) < int(mutation * 1_000_000)
    change = F.array_join(F.transform(F.split("cut", ""), lambda c, i: F.when(place(i), F.translate(c, "ACGT", "CGTA")).otherwise(c)), "")
    void, kind = F.col("id") % 10 == 0, F.col("id") % 6
    text = F.when(void, "N" * length).when(kind == 4, B.reverse_complement(F.col("cut"))).when(kind == 5, change).otherwise(F.col("cut"))
    doc = F.col("document_id")
    both = F.when(doc % 8 == 1, F.array(doc - 1, doc)).when((doc % 8 == 0) & (doc + 1 < n), F.array(doc, doc + 1)).otherwise(F.array(doc))
    expected = F.when(void, F.array().cast("array<long>")).otherwise(both)
    return rows.withColumn("cut", cut).select(F.concat(F.lit("query"), "id").alias("query_id"), text.alias("sequence"), expected.alias("expected_document_ids"))

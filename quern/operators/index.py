"""The multi-k index: occurrences, postings and dictionary as DataFrames, and their tables.

Postings are shuffled once, by seed and range of documents, for the dictionary.  Texts are dealt anew before
windows are cut, so that a large file split does not make all windows in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import bases as B

DEFAULT_THRESHOLDS = (2, 16, 128)
FORMAT_VERSION = 1
#: Documents of a range of a seed's postings.
PART = 65_536
#: Words that are cut from one piece of a sequence.
PIECE = 256


def check_thresholds(thresholds) -> tuple[int, int, int]:
    t = tuple(int(x) for x in thresholds)
    if len(t) != 3 or any(x < 0 for x in t) or list(t) != sorted(t):
        raise ValueError("three frequency thresholds are needed, none below the one before")
    return t  # type: ignore[return-value]


def check_ks(ks) -> list[int]:
    """Sizes in ascending order, each once."""
    out = sorted({B.check_k(k) for k in ks})
    if not out:
        raise ValueError("at least one k is needed")
    return out


def windows(seqs: DataFrame, ks, sequence: str = "sequence") -> DataFrame:
    """All words of every size that hold bases only, with 0-based positions: adds ``k, position, word``."""
    out = None
    for k in check_ks(ks):
        # a word is cut from a piece of its sequence: a place in a string is found by counting from its start
        starts = F.when(F.length(sequence) >= k, F.sequence(F.lit(0).cast("long"), F.length(sequence).cast("long") - k, F.lit(PIECE).cast("long")))
        cut = seqs.withColumn(sequence, B.normal(F.col(sequence))).withColumn("_base", F.explode(starts))
        cut = cut.withColumn(sequence, F.substring(F.col(sequence), (F.col("_base") + 1).cast("int"), F.lit(PIECE + k - 1))).where(F.col(sequence).rlike(f"[ACGT]{{{k}}}"))
        cut = cut.withColumn("_clean", B.is_kmer(F.col(sequence))).withColumn("_at", F.explode(F.sequence(F.lit(0), F.length(sequence) - k)))
        cut = cut.withColumn("k", F.lit(k)).withColumn("word", F.substring(F.col(sequence), F.col("_at") + 1, F.lit(k))).withColumn("position", F.col("_base") + F.col("_at"))
        cut = cut.where(F.col("_clean") | B.is_kmer(F.col("word"))).drop(sequence, "_clean", "_base", "_at")
        if k == B.MAX_K:
            # the code of T x 32 is the mark of no code, so poly-A and poly-T of that size are no seeds
            cut = cut.where(~F.col("word").isin("A" * k, "T" * k))
        out = cut if out is None else out.unionByName(cut)
    return out


def occurrences(seqs: DataFrame, ks, canonical: bool = True, keep: tuple[str, ...] = ("document_id", "sequence_id")) -> DataFrame:
    """``keep`` columns with ``k, seed, position, strand`` for every seed of ``seqs``."""
    cut = windows(seqs.select(*keep, "sequence"), ks)
    seed, side = (B.canonical(F.col("word")), B.strand(F.col("word"))) if canonical else (F.col("word"), F.lit(0))
    return cut.select(*keep, "k", seed.alias("seed"), "position", side.alias("strand"))


def posting_sizes(postings: DataFrame) -> DataFrame:
    """Add ``bytes``: what each posting takes in a delta-coded block of its seed.

    The document's step, the sequence's (whole after a new document), the position's (whole
    after a new sequence) at seven bits to a byte, and one byte for the strand.
    """
    order = Window.partitionBy("k", "seed").orderBy("document_id", "sequence_id", "position", "strand")
    before = {c: F.lag(c).over(order) for c in ("document_id", "sequence_id", "position")}
    rows = postings.withColumns({f"_{c}": w for c, w in before.items()})
    same_doc = F.coalesce(F.col("document_id") == F.col("_document_id"), F.lit(False))
    same_seq = same_doc & F.coalesce(F.col("sequence_id") == F.col("_sequence_id"), F.lit(False))
    doc = F.col("document_id") - F.coalesce("_document_id", F.lit(0))
    seq = F.when(same_doc, F.col("sequence_id") - F.col("_sequence_id")).otherwise(F.col("sequence_id"))
    pos = F.when(same_seq, F.col("position") - F.col("_position")).otherwise(F.col("position"))
    size = B.varint_length(doc) + B.varint_length(seq) + B.varint_length(pos) + 1
    return rows.withColumn("bytes", size.cast("long")).drop("_document_id", "_sequence_id", "_position")


def dictionary_of(postings: DataFrame, thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """``k, seed, document_frequency, collection_frequency, estimated_posting_bytes, frequency_class``.

    A seed's postings are sized by ranges of ``PART`` documents, so that a seed of the whole corpus
    is many rows of many tasks; only one row for each range is brought together, which adds the
    step from the range before.
    """
    own = ["k", "seed", "_part"]
    rows = postings.withColumn("_part", F.floor(F.col("document_id") / F.lit(PART)))
    order = Window.partitionBy(*own).orderBy("document_id", "sequence_id", "position", "strand")
    rows = rows.withColumns({f"_{c}": F.lag(c).over(order) for c in ("document_id", "sequence_id", "position")})
    first = F.col("_document_id").isNull()
    same_doc = F.coalesce(F.col("document_id") == F.col("_document_id"), F.lit(False))
    same_seq = same_doc & (F.col("sequence_id") == F.col("_sequence_id"))
    doc = F.when(first, 0).otherwise(B.varint_length(F.col("document_id") - F.col("_document_id")))
    seq = B.varint_length(F.when(same_doc, F.col("sequence_id") - F.col("_sequence_id")).otherwise(F.col("sequence_id")))
    pos = B.varint_length(F.when(same_seq, F.col("position") - F.col("_position")).otherwise(F.col("position")))
    parts = rows.groupBy(*own).agg(F.sum((~same_doc).cast("long")).alias("df"), F.count("*").alias("cf"), F.sum((doc + seq + pos + 1).cast("long")).alias("bytes"), F.min("document_id").alias("low"), F.max("document_id").alias("high"))
    before = F.coalesce(F.lag("high").over(Window.partitionBy("k", "seed").orderBy("_part")), F.lit(0))
    parts = parts.withColumn("bytes", F.col("bytes") + B.varint_length(F.col("low") - before))
    grouped = parts.groupBy("k", "seed").agg(F.sum("df").alias("document_frequency"), F.sum("cf").alias("collection_frequency"), F.sum("bytes").alias("estimated_posting_bytes"))
    return grouped.withColumn("frequency_class", B.frequency_class(F.col("collection_frequency"), check_thresholds(thresholds)))


@dataclass(frozen=True)
class Index:
    """Three tables and what is known of them."""

    sequences: DataFrame
    dictionary: DataFrame
    postings: DataFrame
    document_count: int
    ks: list[int]
    thresholds: tuple[int, int, int] = DEFAULT_THRESHOLDS
    source: str = ""
    checksum: str = ""
    command: str = ""
    #: Whether the dictionary is worked out from the postings anew each time.
    lazy: bool = False
    extra: dict = field(default_factory=dict)
    #: ``document_id, sequence_id, sequence`` where seeds can be cut from them instead of read from postings.
    texts: DataFrame | None = None
    #: Ranges that the texts are dealt to, once they are written.
    ranges: int = 0

    def lookup(self, seeds: DataFrame, how: str = "inner") -> DataFrame:
        """Dictionary rows of ``seeds(k, seed)``; ``left_semi`` and ``left_anti`` give the seeds found or missing."""
        return seeds.join(self.dictionary, ["k", "seed"], how)

    def fetch(self, seeds: DataFrame) -> DataFrame:
        """Postings of ``seeds(k, seed)``."""
        return seeds.join(self.postings, ["k", "seed"])

    def header(self) -> dict:
        """What the manifest tells of an index."""
        return {"version": FORMAT_VERSION, "document_count": self.document_count, "ks": self.ks, "thresholds": list(self.thresholds), "source": self.source, "checksum": self.checksum, "command": self.command}

    def describe(self) -> DataFrame:
        """One row for each layer: seeds, postings, bytes, largest frequencies, seeds of each class."""
        cls = F.col("frequency_class")
        return self.dictionary.groupBy("k").agg(
            F.count("*").alias("distinct_seeds"), F.sum("collection_frequency").alias("postings"), F.sum("estimated_posting_bytes").alias("posting_bytes"), F.max("collection_frequency").alias("max_cf"), F.max("document_frequency").alias("max_df"),
            *(F.count_if(cls == i).alias(f"{name}_seeds") for i, name in enumerate(B.CLASS_LABELS)),
        )


def build_index(sequences: DataFrame, ks, thresholds=DEFAULT_THRESHOLDS, partitions: int | None = None, family: str = "kmer", **about) -> Index:
    """Index ``sequences(document_id, sequence_id, name, sequence)`` for all sizes ``ks``; k-mers are the only seed family."""
    if family != "kmer":
        raise ValueError(f"seeds of this family are not made: {family}")
    ks, thresholds = check_ks(ks), check_thresholds(thresholds)
    spark = sequences.sparkSession
    seqs = sequences.select("document_id", "sequence_id", "name", "sequence")
    dealt = seqs.repartition(partitions or 4 * spark.sparkContext.defaultParallelism, "sequence_id")
    postings = occurrences(dealt, ks).select("k", "seed", "document_id", "sequence_id", "position", "strand")
    about.setdefault("document_count", seqs.select("document_id").distinct().count())
    meta = seqs.select("document_id", "sequence_id", "name", F.length("sequence").cast("long").alias("length"))
    return Index(meta, dictionary_of(postings, thresholds), postings, ks=ks, thresholds=thresholds, lazy=True, texts=seqs.drop("name"), **about)


def write_index(index: Index, path: str) -> Index:
    """Write an index as Parquet tables, parted by k and sorted, and a manifest; return it as read."""
    spark = index.sequences.sparkSession
    if not index.ks:
        raise ValueError("an index needs a layer")
    index.sequences.write.mode("overwrite").parquet(f"{path}/sequences")
    index.postings.repartition("k", "seed").sortWithinPartitions("k", "seed", "document_id", "sequence_id", "position", "strand").write.mode("overwrite").partitionBy("k").parquet(f"{path}/postings")
    schema = index.postings.schema
    postings = spark.read.schema(schema).parquet(f"{path}/postings")
    dictionary_of(postings, index.thresholds).sortWithinPartitions("k", "seed").write.mode("overwrite").partitionBy("k").parquet(f"{path}/dictionary")
    counts = {str(r["k"]): [r["n"], r["cf"]] for r in spark.read.parquet(f"{path}/dictionary").groupBy("k").agg(F.count("*").alias("n"), F.sum("collection_frequency").alias("cf")).collect()}
    if set(counts) != {str(k) for k in index.ks}:
        raise ValueError(f"layers without seeds: {sorted(set(index.ks) - {int(k) for k in counts})}")
    manifest = {"sums": {t: _sum_of(spark, path, t) for t in TABLES}, "version": FORMAT_VERSION, "document_count": index.document_count, "ks": index.ks, "thresholds": list(index.thresholds), "source": index.source, "checksum": index.checksum, "command": index.command, "counts": counts}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return read_index(spark, path)


TABLES = ("sequences", "dictionary", "postings")


def _sum_of(spark: SparkSession, path: str, table: str) -> str:
    """A sum over all rows' hashes, whatever their order."""
    rows = spark.read.parquet(f"{path}/{table}")
    return str(rows.agg(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()[0])


def read_index(spark: SparkSession, path: str, ks=None, cache: bool = False, check: bool = False) -> Index:
    """An index as written; ``ks`` reads those layers only, ``cache`` keeps its tables in memory or on disk.

    ``check`` reads all tables and compares them with the sums in the manifest.
    """
    rows = spark.read.text(f"{path}/manifest").collect()
    try:
        m = json.loads(rows[0][0])
    except (IndexError, ValueError) as e:
        raise ValueError(f"no manifest in {path}") from e
    if m.get("version") != FORMAT_VERSION or not m.get("ks"):
        raise ValueError(f"unknown index version or no layer: {m.get('version')}")
    wrong = [t for t in TABLES if check and _sum_of(spark, path, t) != m["sums"][t]]
    if wrong:
        raise ValueError(f"damaged tables: {', '.join(wrong)}")
    own = check_ks(ks) if ks else m["ks"]
    if not set(own) <= set(m["ks"]):
        raise ValueError(f"no such layer: {sorted(set(own) - set(m['ks']))}")
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("dictionary", "postings")]
    tables = [t.where(F.col("k").isin(own)) for t in tables]
    if cache:
        tables = [t.persist() for t in tables]
    return Index(spark.read.parquet(f"{path}/sequences"), *tables, document_count=m["document_count"], ks=own, thresholds=tuple(m["thresholds"]), source=m["source"], checksum=m["checksum"], command=m["command"], extra={"counts": m["counts"]})


def validate(index: Index) -> list[str]:
    """What is wrong with an index; nothing for a sound one."""
    wrong = []
    if not index.sequences.take(1):
        wrong.append("no sequences")
    if index.sequences.select("document_id").distinct().count() != index.document_count:
        wrong.append("document count differs from the sequences")
    mine = index.dictionary.groupBy("k").agg(F.count("*").alias("n"), F.sum("collection_frequency").alias("cf"), F.sum("estimated_posting_bytes").alias("b"), F.max("frequency_class").alias("top"))
    theirs = posting_sizes(index.postings).groupBy("k").agg(F.count_distinct("seed").alias("pn"), F.count("*").alias("pcf"), F.sum("bytes").alias("pb"), F.max("strand").alias("ps"))
    for r in mine.join(theirs, "k", "full").collect():
        if r["n"] != r["pn"]:
            wrong.append(f"k={r['k']}: {r['n']} dictionary entries, {r['pn']} posting lists")
        if r["cf"] != r["pcf"] or r["b"] != r["pb"]:
            wrong.append(f"k={r['k']}: frequencies or sizes differ from the postings")
        if (r["ps"] or 0) > 1 or (r["top"] or 0) > 3:
            wrong.append(f"k={r['k']}: a strand or class out of range")
    for k, (n, cf) in index.extra.get("counts", {}).items():
        if int(k) in index.ks:
            now = index.dictionary.where(F.col("k") == int(k)).agg(F.count("*"), F.sum("collection_frequency")).first()
            if (now[0], now[1] or 0) != (n, cf or 0):
                wrong.append(f"k={k}: counts differ from the manifest")
    if len(index.ks) == 0:
        wrong.append("no layer")
    return wrong


def layer(index: Index, k: int) -> Index:
    """The one-layer index of a size."""
    if k not in index.ks:
        raise ValueError(f"no layer {k}")
    return replace(index, dictionary=index.dictionary.where(F.col("k") == k), postings=index.postings.where(F.col("k") == k), ks=[k])

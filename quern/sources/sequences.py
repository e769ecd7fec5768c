"""FASTA and FASTQ files, truth tables, and what is written of results.

Files are read by Spark, a record to a row; a file is split at record starts, so large files are
read in parallel.  Ordinals are given without a sort in one task: counts by partition first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASIS, PRIME = 1469598103934665603, 1099511628211
#: Rows or lines that are ranked in one task.
BLOCK = 1 << 20


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Lines of text files as ``value``, with their split's file and start for ``_numbered``."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their ordinal, by file name and place, however Spark deals splits to tasks.

    Only one count for each split is shuffled.  ``_first`` marks the first row of each file.
    """
    tagged = rows.withColumn("_id", F.monotonically_increasing_id())
    splits = tagged.groupBy("_path", "_start").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = tagged.join(splits.withColumn("_before", before).drop("_n"), ["_path", "_start"])
    first = (F.col("_start") == 0) & (F.col("_id") == F.col("_low"))
    return joined.withColumn(name, F.col("_before") + F.col("_id") - F.col("_low")).withColumn("_first", first).drop("_path", "_start", "_id", "_low", "_before")


def _record() -> list:
    return ["document_id", F.col("document_id").alias("sequence_id"), "name", "sequence"]


def _ranked(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Ranks, from 0, of rows by their distinct numbers ``n``: by blocks, whose counts alone come together."""
    rows = rows.withColumn("_block", F.floor(F.col(n) / F.lit(BLOCK)))
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(n))
    return rows.withColumn("_own", own).join(blocks.withColumn("_before", before).drop("_c"), "_block").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_block", "_own", "_before")


def read_fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Records of a FASTA file: the whole header is the name, lines are joined, carriage returns stay.

    Bases without a name (before the first header, or under an empty one) go before those of the
    next record, or, with ``strict``, are an error; after the last record they are dropped.
    """
    text = _numbered(_lines(spark, path, "\n>"), "n")
    # a piece starts after its mark, but the first of a file with it, if it is a record at all
    head = F.col("_first") & F.startswith("value", F.lit(">"))
    loose = F.col("_first") & ~F.startswith("value", F.lit(">"))
    body = F.when(head, F.expr("substring(value, 2)")).when(loose, F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    rows = text.select("n", F.split(body, "\n", 2).alias("p"), loose.alias("loose"))
    rows = rows.select("n", "loose", F.col("p")[0].alias("name"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), "\n", "").alias("sequence"))
    nameless = rows.where("name = ''")
    if nameless.isEmpty():
        return rows.withColumnRenamed("n", "document_id").select(*_record())
    # blank lines at the start are no record
    if strict and not nameless.where("NOT (loose AND sequence = '')").isEmpty():
        raise ValueError("a FASTA record has no name")
    # runs of nameless rows end before the record that they belong to
    row = F.row_number().over(Window.orderBy("n"))
    runs = nameless.withColumn("_run", F.col("n") - row)
    lead = runs.groupBy("_run").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "sequence"))), lambda r: r["sequence"])).alias("_lead"), (F.max("n") + 1).alias("n"))
    named = rows.where("name <> ''")
    named = named.join(_ranked(named.select("n"), "n", "document_id"), "n").join(lead.select("n", "_lead"), "n", "left")
    return named.withColumn("sequence", F.concat(F.coalesce("_lead", F.lit("")), "sequence")).select(*_record())


def _dropped(residue: int | None):
    """Of one block of blank lines how many stand where a header is due, if ``r`` lines were dropped before (or of each rest of r by 4)."""

    def fold(numbers: list[int], r: int) -> list[int]:
        out: list[int] = []
        for n in numbers:
            if (n - r - len(out)) % 4 == 0:
                out.append(n)
        return out

    def count(table: pa.Table) -> pa.Table:
        numbers = sorted(table["n"].to_pylist())
        return pa.table({"block": table["block"].slice(0, 1), "drops": pa.array([[len(fold(numbers, r)) for r in range(4)]], pa.list_(pa.int64()))})

    def name(table: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array(fold(sorted(table["n"].to_pylist()), table["r"][0].as_py()), pa.int64())})

    return count if residue is None else name


def _headers_aligned(lines: DataFrame) -> DataFrame:
    """Lines without the blank ones that stand before a header, numbered anew; one row for each block of blanks reaches the driver."""
    blanks = lines.where("value = ''").select("n", F.floor(F.col("n") / F.lit(BLOCK)).alias("block"))
    counts = sorted((r["block"], r["drops"]) for r in blanks.groupBy("block").applyInArrow(_dropped(None), "block long, drops array<long>").collect())
    if not counts:
        return lines
    start, total = [], 0
    for block, drops in counts:
        start.append((block, total))
        total += drops[total % 4]
    starts = lines.sparkSession.createDataFrame(start, "block long, r long")
    gone = blanks.join(F.broadcast(starts), "block").groupBy("block").applyInArrow(_dropped(0), "n long")
    left = lines.join(gone, "n", "left_anti")
    return left.join(_ranked(left.select("n"), "n", "m"), "n").drop("n").withColumnRenamed("m", "n")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of a four-line FASTQ file, blank lines before headers apart; qualities are checked and dropped, carriage returns stay."""
    lines = _headers_aligned(_numbered(_lines(spark, path, "\n"), "n").select("n", "value"))
    rows = lines.withColumn("r", F.floor(F.col("n") / 4)).withColumn("i", F.col("n") % 4)
    records = rows.groupBy("r").agg(*(F.max(F.when(F.col("i") == j, F.col("value"))).alias(c) for j, c in enumerate(("head", "sequence", "plus", "quality"))))
    wrong = F.when(~F.startswith("head", F.lit("@")), "bad FASTQ header").when(F.col("quality").isNull(), "truncated FASTQ record").when(~F.startswith("plus", F.lit("+")), "bad FASTQ plus line").when(F.length("quality") != F.length("sequence"), "FASTQ quality length differs")
    bad = records.select(wrong.alias("w"), "r").where("w IS NOT NULL").orderBy("r").take(1)
    if bad:
        raise ValueError(bad[0][0])
    return records.select(F.col("r").cast("long").alias("document_id"), F.expr("substring(head, 2)").alias("name"), "sequence").select(*_record())


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by the first character that is no white space."""
    head = next((line[0].lstrip()[0] for line in spark.read.text(path).where("trim(value) <> ''").take(1) if line[0].strip()), "")
    if head == ">":
        return read_fasta(spark, path)
    if head == "@":
        return read_fastq(spark, path)
    raise ValueError("neither FASTA nor FASTQ")


def write_fasta(records: DataFrame, path: str) -> None:
    """Two lines for each record, as a folder of text files in record order."""
    records.orderBy("sequence_id").select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, expected_document_ids`` of a truth table; a later row of a query replaces an earlier one."""
    lines = _numbered(_lines(spark, path), "n")
    rows = lines.where("value <> '' AND NOT (n = 0 AND startswith(value, 'query_id\t'))").select("n", F.split("value", "\t").alias("p"))
    other = rows.where(F.coalesce(F.get("p", F.lit(1)), F.lit("")) != "exact_retrieval").take(1)
    if other:
        raise ValueError("truth of another comparison stage")
    ids = F.transform(F.filter(F.split(F.coalesce(F.get("p", F.lit(2)), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select(F.col("p")[0].alias("query_id"), "n", ids.alias("ids")).groupBy("query_id").agg(F.max_by("ids", "n").alias("expected_document_ids"))


def _fnv(data: bytes) -> str:
    h = BASIS
    for byte in data:
        h = ((h ^ byte) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_fnv(c.as_py()) for c in batch.column(1)])], names=["path", "digest"])


def file_checksum(spark: SparkSession, path: str) -> str:
    """``fnv1a64:`` and 16 hex digits of a file's bytes, by the index format's own start value.

    Files are read where tasks run; of several files the checksum is that of theirs in a row, by name.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_digests, "path string, digest string").orderBy("path").collect()
    return "fnv1a64:" + (files[0]["digest"] if len(files) == 1 else _fnv("".join(r["digest"] for r in files).encode()))


def write_metrics_jsonl(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_metrics_tsv(metrics: DataFrame, path: str) -> None:
    """Nested columns as ``a,b,c;a,b,c``."""
    flat = lambda c, fields: F.array_join(F.transform(c, lambda x: F.concat_ws(",", *(x[f].cast("string") for f in fields))), ";")
    fields = {f.name: f.dataType.elementType.names for f in metrics.schema.fields if f.name in ("per_k_metrics", "topk_results")}
    metrics.withColumns({c: flat(c, names) for c, names in fields.items()}).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_benchmark_json(summary: DataFrame, path: str, ks, early_stop: str = "off", repeats: int = 1) -> None:
    """A benchmark's one row as JSON, with what was run; the cache counts as warm."""
    about = {"schema_version": "0.1.0", "comparison_stage": "exact_retrieval", "cache_mode": "warm", "early_stop_mode": early_stop}
    fixed = [F.lit(v).alias(c) for c, v in about.items()]
    summary.select(*fixed, F.lit(repeats).alias("repeats"), F.array(*(F.lit(k) for k in ks)).alias("k_values"), F.struct("*").alias("metrics")).coalesce(1).write.mode("overwrite").json(path)


def dump(index, path: str) -> None:
    """An index as text: its documents, sequences and layers, a tab between fields."""
    line = lambda kind, *cols: F.concat_ws("\t", F.lit(kind), *(F.col(c).cast("string") for c in cols)).alias("value")
    layers = index.describe()
    about = index.sequences.sparkSession.createDataFrame([(index.source, index.document_count)], "source string, documents long")
    parts = [about.select(line("source", "source")), about.select(line("documents", "documents")), index.sequences.select(line("sequence", "sequence_id", "document_id", "name", "length")), layers.select(line("layer", "k", "distinct_seeds", "postings"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.write.mode("overwrite").text(path)

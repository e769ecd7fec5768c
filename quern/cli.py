"""``python -m quern.cli build|query|dump|validate|bench|generate``."""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evaluate
from quern.operators.index import Index, build_index, read_index, validate, write_index
from quern.operators.search import METRICS, SearchOptions, parse_class, parse_hot_mode, parse_ks, parse_thresholds, query_metrics
from quern.sources import sequences as io
from quern.sources import synthetic
from quern.sources.shipping import ship


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for path in paths:
            p.add_argument(path)
        return p

    def building(p: argparse.ArgumentParser) -> None:
        p.add_argument("--k", type=parse_ks, default=[15])
        p.add_argument("--thresholds", type=parse_thresholds, default=(2, 16, 128))

    def searching(p: argparse.ArgumentParser) -> None:
        for name in ("max-seeds", "max-postings", "max-candidates", "hot-threshold"):
            p.add_argument(f"--{name}", type=int, default=0)
        p.add_argument("--topk", type=int, default=10)
        p.add_argument("--hot-mode", type=parse_hot_mode, default="skip")
        p.add_argument("--hot-class", type=parse_class)

    building(command("build", "sequences", "index"))
    p = command("query", "index", "queries", "output")
    p.add_argument("--format", choices=("jsonl", "tsv"), default="jsonl")
    searching(p)
    command("dump", "index", "output")
    command("validate", "index")
    p = command("bench", "sequences", "queries", "index", "output")
    p.add_argument("--truth")
    p.add_argument("--repeats", type=int, default=1)
    building(p)
    searching(p)
    p = command("generate", "output")
    for name, value in (("documents", 64), ("length", 1000), ("queries", 64), ("query-length", 150), ("seed", 7)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--mutation", type=float, default=0.0)
    return top


def _options(a: argparse.Namespace) -> SearchOptions:
    return SearchOptions(a.topk, a.max_seeds, a.max_postings, a.max_candidates, a.hot_threshold, a.hot_mode, a.hot_class)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    return io.read_sequences(spark, path).select(F.col("name").alias("query_id"), "sequence")


def _build(spark: SparkSession, a: argparse.Namespace) -> Index:
    about = {"source": a.sequences, "checksum": io.file_checksum(spark, a.sequences), "command": " ".join(sys.argv)}
    return write_index(build_index(io.read_sequences(spark, a.sequences), a.k, a.thresholds, **about), a.index)


def _bench(spark: SparkSession, a: argparse.Namespace) -> None:
    """Build, read again, query ``repeats`` times; recall is of the first time."""
    began = time.time()
    _build(spark, a)
    built = time.time()
    index, options, queries = read_index(spark, a.index, cache=True), _options(a), _queries(spark, a.queries)
    loaded, runs = time.time(), []
    for i in range(max(1, a.repeats)):
        query_metrics(index, queries, options).write.mode("overwrite").parquet(f"{a.output}/run-{i}")
        runs.append(spark.read.parquet(f"{a.output}/run-{i}"))
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    summary = evaluate.benchmark(every)
    if a.truth:
        summary = summary.crossJoin(evaluate.recall(runs[0], io.read_truth(spark, a.truth)))  # one row each
    used = resource.getrusage(resource.RUSAGE_SELF)
    measured = {"build_wall_s": built - began, "load_wall_s": loaded - built, "query_wall_s": time.time() - loaded, "driver_cpu_s": used.ru_utime + used.ru_stime, "driver_peak_rss_kb": float(used.ru_maxrss)}
    limited = options.max_seeds or options.max_postings or options.max_candidates or options.hot_threshold or options.hot_class is not None
    io.write_benchmark_json(summary.withColumns({c: F.lit(v) for c, v in measured.items()}), f"{a.output}/summary", index.ks, "heuristic" if limited else "off", len(runs))


def _generate(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = synthetic.documents(spark, a.documents, a.length, a.seed)
    asked = synthetic.queries(docs, a.queries, a.query_length, a.seed, a.mutation)
    io.write_fasta(docs, f"{a.output}/refs.fa")
    io.write_fasta(asked.select(F.col("query_id").alias("name"), F.col("query_id").alias("sequence_id"), "sequence"), f"{a.output}/queries.fa")
    rows = asked.select(F.concat_ws("\t", "query_id", F.lit("exact_retrieval"), F.array_join("expected_document_ids", ","), F.lit("")).alias("value"))
    rows.write.mode("overwrite").text(f"{a.output}/truth.tsv")


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = ship(SparkSession.builder.appName("quern").getOrCreate())
    if a.command == "build":
        print(f"distinct seeds: {_build(spark, a).dictionary.count()}")
    elif a.command == "query":
        asked = io.read_sequences(spark, a.queries)
        metrics = query_metrics(read_index(spark, a.index, check=True), asked.select(F.col("name").alias("query_id"), "sequence"), _options(a))
        # results in the order of the input
        place = asked.groupBy(F.col("name").alias("query_id")).agg(F.min("document_id").alias("_place"))
        metrics = metrics.join(place, "query_id").orderBy("_place").select(*METRICS)
        (io.write_metrics_jsonl if a.format == "jsonl" else io.write_metrics_tsv)(metrics, a.output)
    elif a.command == "dump":
        io.dump(read_index(spark, a.index), a.output)
    elif a.command == "validate":
        index = read_index(spark, a.index, check=True)
        wrong = validate(index)
        print("\n".join(wrong) or f"sound; distinct seeds: {index.dictionary.count()}")
        return int(bool(wrong))
    elif a.command == "bench":
        _bench(spark, a)
    else:
        _generate(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())

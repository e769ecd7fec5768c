"""Truth, recall, floor-rank percentiles and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_hit(results: Column, expected: Column, n: int) -> Column:
    """Whether one of the first ``n`` results is expected; nothing expected is hit by no result."""
    return F.when(F.size(expected) == 0, F.size(results) == 0).otherwise(F.exists(results, lambda r: (r["rank"] <= n) & F.array_contains(expected, r["document_id"])))


def recall(metrics: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries with truth, and recall among the first 1, 5 and 10 (0 without queries)."""
    joined = metrics.join(truth, "query_id")
    hits = [F.coalesce(F.avg(recall_hit(F.col("topk_results"), F.col("expected_document_ids"), n).cast("double")), F.lit(0.0)).alias(f"recall_at_{n}") for n in (1, 5, 10)]
    return joined.agg(F.count("*").alias("truth_queries"), *hits)


def percentile(values: Column, p: float) -> Column:
    """The element at floor(p (n-1)) of the sorted values of a group; 0 for none."""
    p = min(1.0, max(0.0, p))
    listed = F.sort_array(F.collect_list(values))
    at = F.floor(F.lit(p) * (F.size(listed) - 1)).cast("int") + 1
    return F.when(F.size(listed) == 0, F.lit(0)).otherwise(F.element_at(listed, F.greatest(at, F.lit(1))))


def mean(values: Column) -> Column:
    return F.coalesce(F.avg(values), F.lit(0.0))


def benchmark(metrics: DataFrame, truth: DataFrame | None = None, latency: str | None = None) -> DataFrame:
    """One row of means over query runs, and recall where there is truth; percentiles of ``latency`` if named."""
    cols = [F.count("*").alias("query_runs")]
    for c in ("exact_bytes_read", "postings_decoded", "seeds_generated", "seeds_queried", "seeds_skipped_budget", "postings_skipped_budget", "seeds_skipped_hot", "seeds_skipped_frequency_class", "seeds_doc_only_hot", "candidates_created"):
        cols.append(mean(F.col(c)).alias(f"mean_{c}"))
    if latency:
        cols += [percentile(F.col(latency), p / 100).alias(f"{latency}_p{p}") for p in (50, 90, 95, 99)]
    out = metrics.agg(*cols)
    return out if truth is None else out.crossJoin(recall(metrics, truth))  # one row each

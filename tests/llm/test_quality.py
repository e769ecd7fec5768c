"""The quality posteriors against sums by hand, odd rows, and the sample's bound."""

import random

import pytest

from quern.llm import quality
from quern.llm.labelled import labelled_sample, remainder
from quern.sources.workspace import Workspace


def _brute(rows):
    """(site mean, path mean, quality) of each row by the definition."""
    n = len(rows)
    mean = sum(p for *_, p in rows) / n
    group = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    sites, paths = group(lambda r: r[0]), group(lambda r: r[:2])
    avg = lambda x: sum(x) / len(x)
    spread = lambda groups: sum((p - avg(g)) ** 2 for g in groups.values() for p in g) / (n - len(groups))
    k = {}
    w = spread(sites)
    b = (sum(len(g) * (avg(g) - mean) ** 2 for g in sites.values()) - (len(sites) - 1) * w) / (n - sum(len(g) ** 2 for g in sites.values()) / n)
    k["site"] = min(1e6, max(1, w / b)) if b > 0 else 1e6
    w = spread(paths)
    b = sum(len(g) * (avg(g) - avg(sites[s])) ** 2 for (s, _), g in paths.items()) - (len(paths) - len(sites)) * w
    b /= n - sum(len(g) ** 2 / len(sites[s]) for (s, _), g in paths.items())
    k["path"] = min(1e6, max(1, w / b)) if b > 0 else 1e6
    out = []
    for s, h, p in rows:
        site = (sum(sites[s]) - p + k["site"] * mean) / (len(sites[s]) - 1 + k["site"])
        path = (sum(paths[s, h]) - p + k["path"] * site) / (len(paths[s, h]) - 1 + k["path"])
        odds = p / (1 - p) * path / (1 - path) / (mean / (1 - mean))
        out.append((site, path, odds / (1 + odds)))
    return out, k


def test_posteriors(spark):
    draw = random.Random(4)
    level = {s: draw.uniform(0.2, 0.8) for s in ("a", "b", "c", None)}
    rows = [(s, h, min(0.99, max(0.01, draw.gauss(level[s] + (0.1 if h == "x" else -0.1), 0.1)))) for s in level for h in ("x", "y", None) for _ in range(draw.randint(1, 20))]
    # columns of the names that are added or used inside are no obstacle
    df = spark.createDataFrame([(i, *r, 1.0, 2.0, 3.0, 4) for i, r in enumerate(rows)], "id int, site string, path string, p double, global_mean double, quality double, _n double, N_site int").repartition(3)
    sums, prior = quality.path_sums(df, "site", "path", "p", Workspace(spark, "test"))
    out = quality.with_quality(df, sums, prior, "site", "path", "p").orderBy("id").collect()
    told, k = _brute(rows)
    assert 1 < k["site"] < 1e6 and 1 < k["path"] < 1e6
    assert (prior["site_k"], prior["path_k"]) == pytest.approx((k["site"], k["path"]))
    for r, (site, path, q) in zip(out, told, strict=True):
        assert (r["site_mean"], r["path_mean"], r["quality"]) == pytest.approx((site, path, q))
        assert (r["global_mean"], r["_n"], r["N_site"]) == (1.0, 3.0, 4)


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F

    for d, n in ((docs, 1), (docs.limit(0), 0)):
        out = quality.judge(d, labels, F.col("source"), F.col("lang"), Workspace(spark, "test")).collect()
        assert len(out) == n and all(r["quality"] == pytest.approx(0.5) for r in out)


def test_sample_is_bounded_and_outside_the_fold(spark):
    """An id with thousands of rows is one row of the sample."""
    ids = [i for i in range(40)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(3, f"other {j}") for j in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", 5).select("doc_id", "y", (remainder("doc_id") == 0).alias("held")).collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) == 10
    assert not any(r["held"] for r in sample)

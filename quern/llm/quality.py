"""Quality by hierarchical empirical Bayes: a document classifier, corrected by site and path.

The classifier is logistic on the share of characters of several kinds, on repetition of words
and lines and on sizes, fitted on a bounded labelled sample outside the held-out fold.  Its
probabilities are summed by path and by site; a site's posterior mean is shrunk toward the global
mean, a path's toward its site's, each by as many pseudo-documents as the spread between sites,
or between the paths of a site, supports.  A document's odds are multiplied by the odds of its
path's posterior over the global odds; its own probability is left out of both means, so it does
not count twice.

Null texts count as empty; null sites or paths are a site or path of their own.  Repeated rows
count each time (as others of their site); null ids have no label.  Without labels every document
has probability 0.5 and is kept.  An empty table gives an empty result.  Input columns that are
named like an added one are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textblock as tb
from quern.llm.labelled import fresh, labelled_sample, logistic, sigmoid, training_labels
from quern.sources.workspace import Workspace

PER_CLASS = 3000
THRESHOLD = 0.5
_BINS = 8

_KINDS = np.zeros((9, 256), dtype=np.uint8)
_KINDS[0, 97:123] = _KINDS[0, 128:] = 1  # small letters and beyond ASCII
_KINDS[1, 65:91] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, 32] = 1
_KINDS[4, [10, 13]] = 1
for _char in b".,;:'\"-()":
    _KINDS[5, _char] = 1
for _char in b"!?":
    _KINDS[6, _char] = 1
for _char in b"|\t_=/\\<>{}[]":
    _KINDS[7, _char] = 1
for _char in b"#$%&*@^~+`":
    _KINDS[8, _char] = 1
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[10, 13]] = False


def _distinct_share(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the share of distinct values among its values; 1 for none."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    seen = np.unique(tb.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    kinds = np.bincount(row[seen], minlength=len(n))
    return np.where(n > 0, kinds / np.maximum(n, 1), 1.0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text, over the whole text."""
    out = []
    for _, raw, off in tb.blocks(texts):
        n = np.diff(off)
        share = np.zeros((len(n), len(_KINDS)))
        if len(raw):
            for j, kind in enumerate(_KINDS):
                sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
                share[:, j] = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(n, 1)
        word, at = tb.words(raw, off, tb.BLACK)
        line, line_at = tb.words(raw, off, _BREAKS)
        count = np.diff(at)
        pair = tb.mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) > 1 else word[:0]
        pair_at = np.minimum(at, len(pair))
        out.append(
            np.column_stack(
                [share, np.log1p(count), n / np.maximum(count, 1), np.log1p(count / np.maximum(np.diff(line_at), 1)), _distinct_share(word, at), _distinct_share(pair, pair_at), _distinct_share(line, line_at)]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(_KINDS) + 6))


@dataclass
class Classifier:
    """Logistic on the numbers themselves and on steps at their quantiles."""

    centre: np.ndarray
    scale: np.ndarray
    steps: np.ndarray
    beta: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -4, 4)
        return np.column_stack([z, *((x[:, j : j + 1] > self.steps[j]).astype(float) for j in range(x.shape[1]))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if len(self.beta) == 1:
            return np.full(len(x), sigmoid(self.beta)[0])
        d = self.design(x)
        return sigmoid(d @ self.beta[:-1] + self.beta[-1])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    """Fit the classifier on at most ``per_class`` labelled documents of either kind, outside the held-out fold.

    Texts stay where they are; of each sampled one its numbers come to the driver.
    """
    share = training_labels(labels, "quality").agg(F.avg("_y")).first()[0]

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array(list(features(texts)), pa.list_(pa.float64()))

    sample = labelled_sample(documents, labels, "quality", per_class).select("doc_id", "y", numbers("text").alias("x")).toArrow().sort_by("doc_id")
    y = sample["y"].to_numpy().astype(float)
    if share is None or len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(1), np.ones(1), np.zeros((1, 0)), np.zeros(1))
    x = np.array(sample["x"].to_pylist())
    centre, scale = np.median(x, axis=0), np.maximum(x.std(axis=0), 1e-6)
    steps = np.quantile(x, np.arange(1, _BINS) / _BINS, axis=0).T
    model = Classifier(centre, scale, steps, np.zeros(0))
    own = y.mean()
    model.beta = logistic(model.design(x), y, np.where(y == 1, share / own, (1 - share) / (1 - own)), ridge=2.0)
    return model


def document_probability(documents: DataFrame, model: Classifier, text: str = "text") -> Column:
    """The classifier's probability that ``text`` is of good quality."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        if len(texts) == 0:
            return pa.array([], type=pa.float64())
        return pa.array(sent.value.probability(features(texts)))

    return probability(F.col(text))


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _pseudo(within: float, between: float) -> float:
    """Pseudo-documents that a group's mean is shrunk by."""
    return min(1e6, max(1.0, within / between)) if between > 0 else 1e6


def path_sums(scored: DataFrame, site: str, path: str, p: str, ws: Workspace) -> tuple[DataFrame, dict[str, float]]:
    """``(_site, _path, n, s, site_n, site_s)`` and the prior: ``mean, site_k, path_k``.

    Sums are taken before the shuffle, so a site with a third of the documents is one row of each
    task.  Spreads between groups are by the method of moments for groups of unequal size; only
    a few sums of them reach the driver.
    """
    counted = scored.groupBy(F.col(site).alias("_site"), F.col(path).alias("_path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("q"))
    paths = ws.save(counted, "paths")
    sites = paths.groupBy("_site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"), F.sum("q").alias("site_q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_ss"), F.sum(F.col("n").cast("double") * F.col("n")).alias("path_nn"))
    sites = ws.save(sites, "sites")
    number = F.col("site_n").cast("double")
    one = sites.agg(
        F.sum(number).alias("n"), F.sum("site_s").alias("s"), F.sum("site_q").alias("q"), F.count("*").alias("sites"), F.sum("k").alias("paths"), F.sum(F.col("site_s") * F.col("site_s") / number).alias("site_ss"),
        F.sum(number * number).alias("site_nn"), F.sum("path_ss").alias("path_ss"), F.sum(F.col("path_nn") / number).alias("path_nn"),
    ).first()
    n = one["n"] or 0.0
    mean = one["s"] / n if n else 0.5
    prior = {"mean": mean, "site_k": 1e6, "path_k": 1e6}
    if n > (one["sites"] or 0):
        within = max(0.0, one["q"] - one["site_ss"]) / (n - one["sites"])
        room = n - one["site_nn"] / n
        prior["site_k"] = _pseudo(within, (one["site_ss"] - n * mean * mean - (one["sites"] - 1) * within) / room if room > 0 else 0.0)
    if n > (one["paths"] or 0):
        within = max(0.0, one["q"] - one["path_ss"]) / (n - one["paths"])
        room = n - one["path_nn"]
        prior["path_k"] = _pseudo(within, (one["path_ss"] - one["site_ss"] - (one["paths"] - one["sites"]) * within) / room if room > 0 else 0.0)
    joined = paths.join(sites.select(F.col("_site").alias("_s"), "site_n", "site_s"), F.col("_s").eqNullSafe(F.col("_site")))
    return joined.select("_site", "_path", "n", "s", "site_n", "site_s"), prior


def with_quality(scored: DataFrame, sums: DataFrame, prior: dict[str, float], site: str, path: str, p: str) -> DataFrame:
    """Add ``site_mean``, ``path_mean`` (posteriors from all other documents) and ``quality`` to ``scored``."""
    safe = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    name = {c: fresh(scored.columns, f"_{c}") for c in sums.columns}
    right = sums.select(*(F.col(c).alias(n) for c, n in name.items()))
    joined = scored.join(right, scored[site].eqNullSafe(right[name["_site"]]) & scored[path].eqNullSafe(right[name["_path"]]))
    of = lambda c: joined[name[c]]
    own, (mean, site_k, path_k) = joined[p], (prior[c] for c in ("mean", "site_k", "path_k"))
    site_mean = (of("site_s") - own + site_k * mean) / (of("site_n") - 1 + site_k)
    path_mean = (of("s") - own + path_k * site_mean) / (of("n") - 1 + path_k)
    odds = _odds(safe(own)) * _odds(safe(path_mean)) / _odds(safe(F.lit(mean)))
    added = {"site_mean": site_mean, "path_mean": path_mean, "quality": odds / (1 + odds)}
    return joined.select(*(joined[c] for c in scored.columns if c not in added), *(e.alias(c) for c, e in added.items()))


def judge(documents: DataFrame, labels: DataFrame, site: F.Column, path: F.Column, ws: Workspace, training: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``_site, _path, _p, site_mean, path_mean, quality``; texts are scored once."""
    model = fit(documents if training is None else training, labels)
    kept = documents.columns if keep is None else keep
    scored = ws.save(documents.select(*kept, site.alias("_site"), path.alias("_path"), document_probability(documents, model).alias("_p")), "scored")
    return with_quality(scored, *path_sums(scored, "_site", "_path", "_p", ws), "_site", "_path", "_p")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality: ``doc_id, site, path, doc_probability, site_mean, path_mean, quality, kept``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = judge(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", "lang"), Workspace(spark, "quality"), keep=["doc_id"])
    return result.select("doc_id", F.col("_site").alias("site"), F.col("_path").alias("path"), F.col("_p").alias("doc_probability"), "site_mean", "path_mean", "quality", (F.col("quality") >= THRESHOLD).alias("kept"))

"""Counting of runs in bounded memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_toxicity_counts import test_tables_equal_brute_force as equal_brute_force

from quern.llm import toxicity


class Sent:
    value = np.zeros(0, dtype=np.uint64)


def _texts(n_words):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(words, k=2000)) for _ in range(n_words // 2000)]
    return pa.RecordBatch.from_pydict({"text": pa.array(texts), "role": pa.array([i % 4 for i in range(len(texts))], pa.int32())})


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_flush_takes_few_bytes_a_word():
    texts = _texts(400_000)
    assert _peak(lambda: list(toxicity._runs(24, True)(iter([texts])))) < 100 * 400_000


@pytest.mark.parametrize("triples", [True, False])
def test_a_bucket_is_merged_in_parts(monkeypatch, triples):
    monkeypatch.setattr(toxicity, "RUNS", 20_000, raising=False)
    table = pa.Table.from_batches(toxicity._runs(1, triples, 100_000)(iter([_texts(400_000)])))
    merge = toxicity._told(8.0) if triples else toxicity._followed(3.0, Sent)
    assert _peak(lambda: merge(table)) < 20 * 400_000


def test_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_parts", lambda table, columns: 5)
    equal_brute_force(spark, 50)

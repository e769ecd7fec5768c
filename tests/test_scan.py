"""Seeds counted and scored where the texts lie, against the postings of the same index, as written."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import bases as B
from quern.operators import scan
from quern.operators.index import build_index, read_index, write_index
from quern.operators.search import SearchOptions, narrowed, query_metrics, search
from quern.plans import catalog
from quern.sources.workspace import Workspace

DATA = "/root/testdata/sf0.001"
OPTIONS = [
    SearchOptions(topk=3), SearchOptions(topk=3, max_seeds=5), SearchOptions(topk=3, max_postings=20), SearchOptions(topk=2, hot_threshold=6), SearchOptions(topk=3, hot_threshold=6, hot_mode="doc_only"),
    SearchOptions(topk=2, max_candidates=4), SearchOptions(topk=9, max_candidates=3, hot_class=2, hot_mode="doc_only"), SearchOptions(topk=0),
]


@pytest.fixture(scope="module")
def tables(spark):
    """Long and short texts, copies, parts turned around, odd characters, null, several and repeated sequences of a document."""
    rnd = random.Random(5)
    base = ["".join(rnd.choices("ACGT", k=rnd.randint(0, 120))) for _ in range(30)]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = base + [flip(s) for s in base[:8]] + [s + "é😀n" + flip(s) + s.lower() for s in base[8:16]] + ["ACAC" * 30, "ACACNACAC" * 9, "", None]
    rows = [(i // 2 * 3 if i % 5 else i, i, f"d{i}", s) for i, s in enumerate(texts)]
    rows.append(rows[3])
    seqs = spark.createDataFrame(rows, "document_id long, sequence_id long, name string, sequence string")
    queries = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(texts[4:46:3])] + [("qnone", "TTTT")], "query_id string, sequence string")
    index = build_index(seqs, [5, 7], (2, 6, 20), partitions=3)
    ws = Workspace(spark, "scan")
    return index, read_index(spark, write_index(index, ws.path("index")) and ws.path("index")), queries


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_dictionary(spark, tables, monkeypatch):
    index, written, queries = tables
    monkeypatch.setattr(scan, "SEEDS", 60)
    columns = ["k", "seed", "document_frequency", "collection_frequency", "estimated_posting_bytes", "frequency_class"]
    got, want = (narrowed(i, queries, Workspace(spark, "scan")).dictionary.select(*columns) for i in (index, written))
    assert rows_of(got) == rows_of(want) and got.count() > 60


@pytest.mark.parametrize("options", OPTIONS)
def test_metrics(tables, options, monkeypatch):
    index, written, queries = tables
    monkeypatch.setattr(scan, "TASKS", 100)
    assert rows_of(query_metrics(index, queries, options)) == rows_of(query_metrics(written, queries, options))


def unread(index):
    """An index whose postings and whole dictionary can't be had."""
    return replace(index, postings=index.postings.where(F.raise_error(F.lit("postings were read")).cast("boolean")), dictionary=index.dictionary.where(F.raise_error(F.lit("all seeds were counted")).cast("boolean")))


def test_postings_are_not_read(tables):
    index, written, queries = tables
    assert rows_of(search(unread(index), queries, OPTIONS[0], 6)) == rows_of(search(written, queries, OPTIONS[0], 6))


@pytest.mark.parametrize("name", ["search_topk", "search_max_candidates", "search_max_seeds", "conservative_stop_flag"])
def test_queries(spark, name, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    index_of = catalog._index
    monkeypatch.setattr(catalog, "_index", lambda *args: (lambda index, queries: (unread(index), queries))(*index_of(*args)))
    got = catalog.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(catalog.ORACLES[name]).select(*got.columns).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_queries(tables):
    index, _, queries = tables
    assert search(index, queries.limit(0)).count() == 0
    assert search(index, queries.where("query_id = 'qnone'")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 11, 15, 16, 31, 32])
def test_codes(k):
    rnd = random.Random(k)
    text = "".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=300)) + "A" * 40 + "T" * 40
    code, strand, clean = scan.codes(np.frombuffer(text.encode(), dtype=np.uint8), k)
    for i in range(len(text) - k + 1):
        word = text[i : i + k]
        back = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert clean[i] == (set(word) <= set("ACGT") and not (k == B.MAX_K and word in ("A" * k, "T" * k)))
        if clean[i]:
            assert (int(code[i]), bool(strand[i])) == (int(min(word, back).translate(str.maketrans("ACGT", "0123")), 4), back < word)


def test_hits_in_several_parts(monkeypatch):
    """Sums do not depend on how many hits are added at once."""
    rnd = np.random.default_rng(1)
    at = np.sort(rnd.integers(0, 20, 400))
    lists = {False: (np.searchsorted(at, np.arange(21)), rnd.integers(0, 10, 400), rnd.integers(0, 99, 400))}
    p = {"start": np.array([0, 20]), "seed": rnd.permutation(20), "once": np.zeros(20, bool), "information": rnd.random(20), "times": rnd.integers(1, 3, 20), "rank": np.arange(1, 21)}
    whole = scan._of_query(p, 0, lists, 10, True)
    monkeypatch.setattr(scan, "HITS", 7)
    for a, b in zip(whole, scan._of_query(p, 0, lists, 10, True), strict=True):
        assert np.array_equal(a, b)


def test_counting_takes_few_bytes_a_hit(monkeypatch):
    """Hits of all seeds of a range are summed in parts, with the same sums."""
    rnd = np.random.default_rng(2)
    text = rnd.choice(np.frombuffer(b"ACGT", np.uint8), (100, 4000))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(100)), pa.array(np.arange(100)), pa.array([t.tobytes() for t in text], pa.binary())], names=["document_id", "sequence_id", "letters"])

    class Sent:
        value = {6: np.unique(scan.codes(text[0], 6)[0])}

    def run():
        return pa.Table.from_batches(scan._sums(Sent)(iter([batch])))

    whole = run()
    monkeypatch.setattr(scan, "CUT", 5_000)
    tracemalloc.start()
    parts = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts.equals(whole.combine_chunks()) and parts.num_rows == len(Sent.value[6])
    assert peak < 60 * sum(whole["cf"].to_pylist())

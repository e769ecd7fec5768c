"""The bundled example: index totals, rankings and policies."""

import pytest

from quern.operators.index import build_index, validate
from quern.operators.search import SearchOptions, query_metrics

REFS = ["ACGTTGCATGTCGCATGATGCATGAGAGCT", "AGCTCTCATGCATCATGCGACATGCAACGT", "AAAAACCCCCAAAAACCCCCGGGGGTTTTT", "ACGTNNNNNNNNACGTACGTACGT"]
QUERIES = {"q_doc0_exact": "TGCATGTCGCATGATG", "q_doc2_repeat": "AAAAACCCCC", "q_ambiguous_split": "ACGTNNNNACGTACGT", "q_absent": "TATATATATATA"}


@pytest.fixture(scope="module")
def index(spark):
    seqs = spark.createDataFrame([(i, i, f"doc{i}", s) for i, s in enumerate(REFS)], "document_id long, sequence_id long, name string, sequence string")
    return build_index(seqs, [7, 5], partitions=2)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id string, sequence string")


def test_index(index):
    rows = {r["k"]: (r["distinct_seeds"], r["postings"], r["posting_bytes"], r["rare_seeds"], r["medium_seeds"], r["max_cf"]) for r in index.describe().collect()}
    assert rows == {5: (35, 86, 344, 24, 11, 6), 7: (39, 78, 312, 34, 5, 4)}
    assert validate(index) == []


def test_search(index, queries):
    got = {r["query_id"]: r for r in query_metrics(index, queries, SearchOptions(topk=3)).collect()}
    r = got["q_doc0_exact"]
    assert (r["seeds_generated"], r["seeds_queried"], r["exact_bytes_read"], r["postings_decoded"], r["candidates_created"], r["candidates_touched"]) == (22, 21, 208, 52, 4, 52)
    assert [(x["document_id"], x["strand"], x["supporting_seeds"], round(x["score"], 4)) for x in r["topk_results"]] == [(0, "reverse", 21, 10.7273), (1, "forward", 21, 10.7273), (0, "forward", 8, 4.0866)]
    assert got["q_absent"]["seeds_generated"] == 14 and got["q_absent"]["topk_results"] == []


@pytest.mark.parametrize(
    "options,expected",
    [
        (SearchOptions(topk=3, max_seeds=3), (3, 6, 6, 19, 0, 0, "max_seeds_budget")),
        (SearchOptions(topk=3, max_postings=10), (5, 10, 10, 0, 17, 0, "max_postings_budget")),
        (SearchOptions(topk=3, hot_threshold=4), (19, 40, 40, 0, 0, 3, "none")),
        (SearchOptions(topk=3, hot_threshold=4, hot_mode="doc_only"), (21, 52, 46, 0, 0, 0, "none")),
    ],
)
def test_policies(index, queries, options, expected):
    r = query_metrics(index, queries.where("query_id = 'q_doc0_exact'"), options).first()
    assert (r["seeds_queried"], r["postings_decoded"], r["candidates_touched"], r["seeds_skipped_budget"], r["postings_skipped_budget"], r["seeds_skipped_hot"], r["early_stop_rule"]) == expected

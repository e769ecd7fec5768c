"""Registered queries over the driver's tables, and the same in SQL.

Sequences are the letters A, C, G and T of each document's text; queries are the
whole sequences of the documents whose id is divisible by 100, as a stated query set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import bases as B
from quern.functions import codecs
from quern.operators import evaluate
from quern.operators.index import Index, build_index, layer, occurrences, validate, write_index
from quern.operators.search import SearchOptions, narrowed, per_k_metrics, plan, prepared, query_metrics, results, search, tasks
from quern.sources.sequences import read_fasta, write_fasta
from quern.sources.workspace import Workspace

KS = (11, 15)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = B.normal(F.regexp_replace("text", "[^ACGTacgt]", ""))
    return docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("sequence_id"), F.concat(F.lit("doc"), "doc_id").alias("name"), letters.alias("sequence"))


def queries_of(seqs: DataFrame) -> DataFrame:
    return seqs.where("document_id % 100 = 0").select("document_id", F.col("name").alias("query_id"), "sequence")


def _index(spark: SparkSession, sf_dir: str, ks=KS) -> tuple[Index, DataFrame]:
    seqs = sequences(spark, sf_dir)
    return build_index(seqs, ks), queries_of(seqs)


def _longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def base_composition(spark, sf_dir):
    s = F.col("sequence")
    count = lambda b: (F.length(s) - F.length(F.translate(s, b, ""))).cast("long")
    return sequences(spark, sf_dir).select("document_id", F.length(s).cast("long").alias("length"), *(count(b).alias(f"n_{b.lower()}") for b in "ACGT"), B.reverse_complement(F.substring(s, 1, 20)).alias("head_rc"))


def canonical_kmers(spark, sf_dir):
    occ = occurrences(sequences(spark, sf_dir), [15])
    return occ.select("document_id", "position", "seed", F.col("strand").cast("long").alias("strand"), B.kmer_code(F.col("seed")).cast("long").alias("code"))


def kmer_dictionary(spark, sf_dir):
    d = _index(spark, sf_dir)[0].dictionary
    return _longs(d, "k", "frequency_class")


def layer_summary(spark, sf_dir):
    return _longs(_index(spark, sf_dir)[0].describe(), "k")


def seed_plan(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    p = plan(queries, narrowed(index, queries, Workspace(spark, "plan")))
    return p.select("query_id", F.col("k").cast("long").alias("k"), "seed", "position", F.round("information", 6).alias("information"), F.round("priority", 6).alias("priority"), "skip_reason")


def seed_tasks(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    t = tasks(plan(queries, narrowed(index, queries, Workspace(spark, "plan"))))
    return t.select("query_id", F.col("k").cast("long").alias("k"), "seed", "occurrence_count", "first_position", F.round("information", 6).alias("information"))


def _ranked(spark, sf_dir, options: SearchOptions, ks=KS):
    index, queries = _index(spark, sf_dir, ks)
    best = search(index, queries, options, 6)
    return best.select("query_id", "rank", "document_id", "sequence_name", B.strand_label(F.col("strand")).alias("strand"), "supporting_seeds", "score")


def search_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, SearchOptions(topk=10), (15,))


def search_topk_multi_k(spark, sf_dir):
    return _ranked(spark, sf_dir, SearchOptions(topk=10))


def search_hot_skip(spark, sf_dir):
    return _ranked(spark, sf_dir, SearchOptions(topk=10, hot_threshold=40))


def search_hot_class_doc_only(spark, sf_dir):
    return _ranked(spark, sf_dir, SearchOptions(topk=10, hot_class=2, hot_mode="doc_only"))


def search_counters(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    m = query_metrics(index, queries, SearchOptions(topk=5, hot_threshold=40))
    return m.select("query_id", "seeds_generated", "seeds_queried", "seeds_skipped_hot", "exact_bytes_read", "postings_decoded", "candidates_created", "early_stop_fired", "early_stop_rule")


def search_max_postings(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    m = query_metrics(index, queries, SearchOptions(topk=5, max_seeds=60, max_postings=400))
    return m.drop("per_k_metrics", "topk_results", "peak_accumulator_bytes", "elapsed_ns")


def search_max_seeds(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    m = query_metrics(index, queries, SearchOptions(topk=5, max_seeds=60))
    return m.select("query_id", "seeds_generated", "seeds_queried", "seeds_skipped_budget", "postings_skipped_budget", "exact_bytes_read", "postings_decoded", "candidates_touched", "early_stop_fired", "early_stop_rule")


def search_max_candidates(spark, sf_dir):
    """The candidates that a limit admits: the first ones touched."""
    index, queries = _index(spark, sf_dir)
    options = SearchOptions(max_candidates=20)
    scored = results(prepared(index, queries, options), options, 0)[0]
    return scored.select("query_id", "document_id", F.col("strand").cast("long").alias("strand"), "supporting_seeds", F.round("score", 6).alias("score"))


def task_order(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    t = tasks(plan(queries, narrowed(index, queries, Workspace(spark, "plan"))))
    return t.select("query_id", F.col("k").cast("long").alias("k"), "seed", "task_rank")


def ambiguous_split(spark, sf_dir):
    """Frequencies of 4-mers of the raw texts, in which most windows hold other characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seqs = docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("sequence_id"), F.col("text").alias("sequence"))
    found = occurrences(seqs, [4]).groupBy("seed").agg(F.count("*").alias("collection_frequency"), F.count_distinct("document_id").alias("document_frequency"))
    return found


def noncanonical_kmers(spark, sf_dir):
    """Forward words of 11 bases as they stand."""
    found = occurrences(sequences(spark, sf_dir), [11], canonical=False)
    return found.groupBy("seed").agg(F.count("*").alias("collection_frequency"), F.max("strand").cast("long").alias("strand"))


def _asked(spark, sf_dir):
    """The documents' index and the distinct seeds of all benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    seqs = items.select(F.col("item_id").alias("document_id"), F.col("item_id").alias("sequence_id"), B.normal(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("sequence"))
    return build_index(sequences(spark, sf_dir), (15,)), occurrences(seqs, [15]).select("k", "seed").distinct()


def dictionary_semi(spark, sf_dir):
    index, asked = _asked(spark, sf_dir)
    return _longs(index.lookup(asked, "left_semi"), "k")


def dictionary_anti(spark, sf_dir):
    index, asked = _asked(spark, sf_dir)
    return _longs(index.lookup(asked, "left_anti"), "k")


def posting_fetch(spark, sf_dir):
    """Postings of the benchmark's seeds, counted by document."""
    index, asked = _asked(spark, sf_dir)
    return index.fetch(asked).groupBy("document_id").agg(F.count("*").alias("postings"), F.min("position").alias("first_position"))


def index_validate(spark, sf_dir):
    """How many faults a sound index has."""
    index = write_index(_index(spark, sf_dir, (15,))[0], Workspace(spark, "index").path("tables"))
    return spark.createDataFrame([(len(validate(index)),)], "faults long")


def count_percentiles(spark, sf_dir):
    """Floor-rank percentiles and mean of the lengths of sequences."""
    n = F.length("sequence").cast("long")
    return sequences(spark, sf_dir).agg(*(evaluate.percentile(n, p / 100).alias(f"p{p}") for p in (0, 50, 90, 95, 99, 100)), F.round(evaluate.mean(n), 6).alias("mean"))


def conservative_stop_flag(spark, sf_dir):
    """Whether the best of each query is out of reach of the second by what the third has."""
    best = _ranked(spark, sf_dir, SearchOptions(topk=3), (15,)).groupBy("query_id").pivot("rank", [1, 2, 3]).agg(F.first("score"))
    score = [F.coalesce(F.col(str(i)), F.lit(0.0)) for i in (1, 2, 3)]
    return best.select("query_id", B.conservative_stop(*score).alias("stop"))


def base_codes(spark, sf_dir):
    """Codes of the first base and the first 15-mer of each sequence, there and back."""
    s = sequences(spark, sf_dir).where(F.length("sequence") >= 15).select("document_id", F.substring("sequence", 1, 15).alias("word"))
    code = B.encode_base(F.lower(F.substring("word", 1, 1)))
    cls = B.class_label((F.col("document_id") % 4).cast("int"))
    return s.select(
        "document_id", code.cast("long").alias("code"), B.decode_base(code).alias("base"), B.complement_bits(code).cast("long").alias("complement"),
        B.kmer_code(F.col("word")).cast("long").alias("forward_code"), B.reverse_complement_code(F.col("word")).cast("long").alias("reverse_code"), cls.alias("label"),
    )


def per_k_counters(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return _longs(per_k_metrics(index, queries), "k").select("query_id", "k", "seeds_generated", "seeds_queried", "exact_bytes_read", "postings_decoded")


def truth_recall(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    m = query_metrics(index, queries, SearchOptions(topk=10))
    return evaluate.recall(m, queries.select("query_id", F.array("document_id").alias("expected_document_ids")))


def posting_blocks(spark, sf_dir):
    """Postings coded to blocks and read back."""
    rows = codecs.read_blocks(codecs.posting_blocks(_index(spark, sf_dir, (15,))[0].postings))
    return rows.select("seed", "document_id", "position", F.col("strand").cast("long").alias("strand"))


def index_tables(spark, sf_dir):
    """Sizes of a layer of an index that was written and read."""
    written = write_index(_index(spark, sf_dir)[0], Workspace(spark, "index").path("tables"))
    return _longs(layer(written, 15).describe(), "k")


def fasta_round_trip(spark, sf_dir):
    """Records written as FASTA and read back: ordinals follow the ids."""
    path = Workspace(spark, "fasta").path("records")
    write_fasta(sequences(spark, sf_dir), path)
    return read_fasta(spark, path).select("document_id", "name", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (search_topk, search_topk_multi_k, search_hot_skip, search_hot_class_doc_only, search_counters, search_max_postings, search_max_seeds, search_max_candidates, task_order, ambiguous_split, noncanonical_kmers, dictionary_semi, dictionary_anti, posting_fetch, index_validate, count_percentiles, conservative_stop_flag, base_codes, per_k_counters, truth_recall, seed_plan, seed_tasks, kmer_dictionary, layer_summary, canonical_kmers, base_composition, posting_blocks, index_tables, fasta_round_trip)
}


def _sql(ks=KS) -> str:
    def occ(source: str, cols: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {cols}, {k}::BIGINT AS k, position, word, reverse(translate(word, 'ACGT', 'TGCA')) AS rc FROM (SELECT {cols}, position, substr(s, position + 1, {k}) AS word FROM (SELECT {cols}, s, unnest(range(0, length(s) - {k - 1}))::BIGINT AS position FROM {source}))" for k in ks
        )

    vlen = lambda v: "(1 + " + " + ".join(f"({v} >= {1 << b})::INT" for b in range(7, 63, 7)) + ")"
    return f"""
WITH seqs AS (SELECT doc_id AS document_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS s FROM documents),
occ AS (SELECT document_id, k, position, least(word, rc) AS seed, (rc < word)::BIGINT AS strand FROM ({occ('seqs', 'document_id')})),
lagged AS (SELECT *, lag(document_id) OVER w AS pd, lag(position) OVER w AS pp FROM occ WINDOW w AS (PARTITION BY k, seed ORDER BY document_id, position, strand)),
sized AS (SELECT *, {vlen('(document_id - coalesce(pd, 0))')} + {vlen('(CASE WHEN document_id = pd THEN 0 ELSE document_id END)')} + {vlen('(CASE WHEN document_id = pd THEN position - pp ELSE position END)')} + 1 AS b FROM lagged),
dict AS (SELECT k, seed, count(DISTINCT document_id)::BIGINT AS df, count(*)::BIGINT AS cf, sum(b)::BIGINT AS bytes FROM sized GROUP BY k, seed),
classed AS (SELECT *, CASE WHEN cf <= 2 THEN 0 WHEN cf <= 16 THEN 1 WHEN cf <= 128 THEN 2 ELSE 3 END::BIGINT AS cls FROM dict),
n AS (SELECT count(*)::DOUBLE AS n FROM seqs),
qs AS (SELECT 'doc' || document_id AS query_id, document_id AS expected, s FROM seqs WHERE document_id % 100 = 0),
qocc AS (SELECT query_id, k, position, least(word, rc) AS seed FROM ({occ('qs', 'query_id')})),
planned AS (SELECT q.*, d.df, d.cf, d.bytes, d.cls, ln((n.n + 1) / (d.df + 1)) * greatest(1, q.k / 15.0::DOUBLE) AS info FROM qocc q CROSS JOIN n LEFT JOIN classed d USING (k, seed)),
task AS (SELECT query_id, k, seed, count(*)::BIGINT AS occurrence_count, min(position)::BIGINT AS first_position, count(*) * first(info) AS information, first(cf) AS cf, first(bytes) AS bytes, first(cls) AS cls FROM planned WHERE df IS NOT NULL GROUP BY query_id, k, seed)
"""


def _top_sql(where: str = "true", doc_only: str = "false", ks=KS) -> str:
    return (
        _sql(ks)
        + f""", found AS (SELECT t.query_id, o.document_id, o.strand, t.k, t.seed, t.information, t.occurrence_count, CASE WHEN {doc_only} THEN 1 ELSE count(*) END AS n
  FROM task t JOIN occ o USING (k, seed) WHERE {where} GROUP BY ALL),
cand AS (SELECT query_id, document_id, strand, sum(n * occurrence_count)::BIGINT AS supporting_seeds, round(sum(n * information), 6) AS score FROM found GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, supporting_seeds DESC, document_id, strand)::BIGINT AS rank FROM cand)
SELECT query_id, rank, document_id, 'doc' || document_id AS sequence_name, CASE strand WHEN 0 THEN 'forward' ELSE 'reverse' END AS strand, supporting_seeds, score FROM ranked WHERE rank <= 10"""
    )


_SUM = "list_reduce(list_transform(range(0, count(*)), lambda i: {0}), lambda a, b: a + b)"


def _rank_sql(ks=KS) -> str:
    """Tasks with their rank; repeated seeds add one by one, as there."""
    return (
        _sql(ks)
        + f""", summed AS MATERIALIZED (SELECT query_id, k, seed, count(*)::BIGINT AS n, min(position) AS first_position, {_SUM.format('min(info)')} AS total, min(info) AS one, min(cf) AS cf, min(bytes) AS bytes
  FROM planned WHERE df IS NOT NULL GROUP BY query_id, k, seed),
ranks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total / greatest(1, bytes) DESC, k, one / greatest(1, bytes) DESC, first_position)::BIGINT AS task_rank FROM summed)
"""
    )


def _code_sql(word: str) -> str:
    return f"list_reduce(list_transform(string_split(translate({word}, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, c: a * 4 + c)"


_ASKED = ", asked AS (SELECT DISTINCT k, seed FROM (SELECT k, least(word, rc) AS seed FROM ({0})))"


def _asked_sql() -> str:
    one = "SELECT item_id, 15::BIGINT AS k, position, word, reverse(translate(word, 'ACGT', 'TGCA')) AS rc FROM (SELECT item_id, position, substr(s, position + 1, 15) AS word FROM (SELECT item_id, s, unnest(range(0, length(s) - 14))::BIGINT AS position FROM (SELECT item_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS s FROM benchmark)))"
    return _sql((15,)) + _ASKED.format(one)


ORACLES: dict[str, str] = {
    "search_topk": _top_sql(ks=(15,)),
    "search_topk_multi_k": _top_sql(),
    "search_hot_skip": _top_sql("t.cf <= 40"),
    "search_hot_class_doc_only": _top_sql(doc_only="t.cls >= 2").replace("GROUP BY ALL),\ncand", "GROUP BY t.query_id, o.document_id, o.strand, t.k, t.seed, t.information, t.occurrence_count, t.cls),\ncand"),
    "seed_plan": _sql() + "SELECT query_id, k, seed, position, round(info, 6) AS information, round(info / greatest(1, bytes), 6) AS priority, CASE WHEN df IS NULL THEN 'absent_from_dictionary' END AS skip_reason FROM planned",
    "seed_tasks": _sql() + "SELECT query_id, k, seed, occurrence_count, first_position, round(information, 6) AS information FROM task",
    "kmer_dictionary": _sql() + "SELECT k, seed, df AS document_frequency, cf AS collection_frequency, bytes AS estimated_posting_bytes, cls AS frequency_class FROM classed",
    "layer_summary": _sql() + "SELECT k, count(*)::BIGINT AS distinct_seeds, sum(cf)::BIGINT AS postings, sum(bytes)::BIGINT AS posting_bytes, max(cf) AS max_cf, max(df) AS max_df, " + ", ".join(f"count(*) FILTER (WHERE cls = {i})::BIGINT AS {c}_seeds" for i, c in enumerate(B.CLASS_LABELS)) + " FROM classed GROUP BY k",
    "per_k_counters": _sql() + """, g AS (SELECT query_id, k, count(*) AS g FROM qocc GROUP BY query_id, k),
t AS (SELECT query_id, k, count(*) AS c, sum(bytes) AS b, sum(cf) AS p FROM task GROUP BY query_id, k),
ks AS (SELECT unnest([11, 15])::BIGINT AS k)
SELECT query_id, k, coalesce(g, 0)::BIGINT AS seeds_generated, coalesce(c, 0)::BIGINT AS seeds_queried, coalesce(b, 0)::BIGINT AS exact_bytes_read, coalesce(p, 0)::BIGINT AS postings_decoded
FROM qs CROSS JOIN ks LEFT JOIN g USING (query_id, k) LEFT JOIN t USING (query_id, k)""",
    "search_counters": _sql() + """, touched AS (SELECT query_id, count(*) AS c FROM (SELECT DISTINCT t.query_id, o.document_id, o.strand FROM task t JOIN occ o USING (k, seed) WHERE t.cf <= 40) GROUP BY query_id),
g AS (SELECT query_id, count(*) AS g FROM qocc GROUP BY query_id),
t AS (SELECT query_id, count(*) FILTER (WHERE cf <= 40) AS q, sum(occurrence_count) FILTER (WHERE cf > 40) AS h, sum(bytes) FILTER (WHERE cf <= 40) AS b, sum(cf) FILTER (WHERE cf <= 40) AS p FROM task GROUP BY query_id)
SELECT query_id, coalesce(g, 0)::BIGINT AS seeds_generated, coalesce(q, 0)::BIGINT AS seeds_queried, coalesce(h, 0)::BIGINT AS seeds_skipped_hot, coalesce(b, 0)::BIGINT AS exact_bytes_read,
 coalesce(p, 0)::BIGINT AS postings_decoded, coalesce(touched.c, 0)::BIGINT AS candidates_created, false AS early_stop_fired, 'none' AS early_stop_rule
FROM qs LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN touched USING (query_id)""",
    "posting_blocks": _sql((15,)) + "SELECT seed, document_id, position, strand FROM occ",
    "index_tables": _sql((15,)) + "SELECT k, count(*)::BIGINT AS distinct_seeds, sum(cf)::BIGINT AS postings, sum(bytes)::BIGINT AS posting_bytes, max(cf) AS max_cf, max(df) AS max_df, " + ", ".join(f"count(*) FILTER (WHERE cls = {i})::BIGINT AS {c}_seeds" for i, c in enumerate(B.CLASS_LABELS)) + " FROM classed GROUP BY k",
    "fasta_round_trip": "SELECT row_number() OVER (ORDER BY doc_id)::BIGINT - 1 AS document_id, 'doc' || doc_id AS name, length(s)::BIGINT AS length, md5(s) AS digest FROM (SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS s FROM documents)",
    "truth_recall": "SELECT count(*)::BIGINT AS truth_queries, " + ", ".join(f"avg((r <= {n})::INT::DOUBLE) AS recall_at_{n}" for n in (1, 5, 10)) + " FROM (SELECT d.doc_id, coalesce(min(t.rank) FILTER (WHERE t.document_id = d.doc_id), 99) AS r FROM documents d LEFT JOIN (" + _top_sql() + ") t ON t.query_id = 'doc' || d.doc_id WHERE d.doc_id % 100 = 0 GROUP BY d.doc_id)",
    "canonical_kmers": _sql((15,)) + "SELECT document_id, position, seed, strand, list_reduce(list_transform(string_split(translate(seed, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, c: a * 4 + c) AS code FROM occ",
    "base_composition": "SELECT doc_id AS document_id, length(s)::BIGINT AS length, " + ", ".join(f"(length(s) - length(replace(s, '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "ACGT") + ", reverse(translate(substr(s, 1, 20), 'ACGT', 'TGCA')) AS head_rc FROM (SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS s FROM documents)",
    "task_order": _rank_sql() + "SELECT query_id, k, seed, task_rank FROM ranks",
    "search_max_seeds": _rank_sql() + """, g AS (SELECT query_id, count(*) AS g FROM qocc GROUP BY query_id),
t AS (SELECT query_id, count(*) FILTER (WHERE task_rank <= 60) AS q, sum(n) FILTER (WHERE task_rank > 60) AS s, sum(bytes) FILTER (WHERE task_rank <= 60) AS b, sum(cf) FILTER (WHERE task_rank <= 60) AS p FROM ranks GROUP BY query_id)
SELECT query_id, coalesce(g, 0)::BIGINT AS seeds_generated, coalesce(q, 0)::BIGINT AS seeds_queried, coalesce(t.s, 0)::BIGINT AS seeds_skipped_budget, 0::BIGINT AS postings_skipped_budget, coalesce(b, 0)::BIGINT AS exact_bytes_read,
 coalesce(p, 0)::BIGINT AS postings_decoded, coalesce(p, 0)::BIGINT AS candidates_touched, coalesce(t.s, 0) > 0 AS early_stop_fired, CASE WHEN coalesce(t.s, 0) > 0 THEN 'max_seeds_budget' ELSE 'none' END AS early_stop_rule
FROM qs LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id)""",
    "search_max_postings": _rank_sql().replace("WITH seqs", "WITH RECURSIVE seqs", 1) + """, fold AS (
  SELECT query_id, 0::BIGINT AS task_rank, 0::BIGINT AS seeds, 0::BIGINT AS used, '' AS outcome, 0::BIGINT AS n, 0::BIGINT AS cf, 0::BIGINT AS bytes FROM qs
  UNION ALL SELECT f.query_id, r.task_rank, f.seeds + (f.seeds < 60 AND f.used + r.cf <= 400)::BIGINT, f.used + CASE WHEN f.seeds < 60 AND f.used + r.cf <= 400 THEN r.cf ELSE 0 END,
    CASE WHEN f.seeds >= 60 THEN 's' WHEN f.used + r.cf > 400 THEN 'p' ELSE 'q' END, r.n, r.cf, r.bytes FROM fold f JOIN ranks r ON r.query_id = f.query_id AND r.task_rank = f.task_rank + 1),
g AS (SELECT query_id, count(*) AS g FROM qocc GROUP BY query_id),
t AS (SELECT query_id, count(*) FILTER (WHERE outcome = 'q') AS q, sum(n) FILTER (WHERE outcome = 's') AS s, sum(n) FILTER (WHERE outcome = 'p') AS ps, sum(bytes) FILTER (WHERE outcome = 'q') AS b, sum(cf) FILTER (WHERE outcome = 'q') AS p,
  arg_max(outcome, task_rank) FILTER (WHERE outcome IN ('s', 'p')) AS last FROM fold GROUP BY query_id),
made AS (SELECT query_id, count(*) AS c FROM (SELECT DISTINCT f.query_id, o.document_id, o.strand FROM fold f JOIN ranks r ON r.query_id = f.query_id AND r.task_rank = f.task_rank JOIN occ o ON o.k = r.k AND o.seed = r.seed WHERE f.outcome = 'q') GROUP BY query_id)
SELECT query_id, 'exact_retrieval' AS comparison_stage, 'multi_k_exact;k=11,15;max_seeds=60;max_postings=400' AS plan_label, coalesce(g, 0)::BIGINT AS seeds_generated, coalesce(q, 0)::BIGINT AS seeds_queried, coalesce(t.s, 0)::BIGINT AS seeds_skipped_budget,
 coalesce(ps, 0)::BIGINT AS postings_skipped_budget, 0::BIGINT AS seeds_skipped_hot, 0::BIGINT AS seeds_skipped_frequency_class, 0::BIGINT AS seeds_doc_only_hot, coalesce(b, 0)::BIGINT AS exact_bytes_read, coalesce(p, 0)::BIGINT AS postings_decoded,
 coalesce(c, 0)::BIGINT AS candidates_created, coalesce(p, 0)::BIGINT AS candidates_touched, 0::BIGINT AS router_seeds_used, 0::BIGINT AS bins_returned, 0::BIGINT AS router_bytes_read, coalesce(t.s, 0) + coalesce(ps, 0) > 0 AS early_stop_fired,
 CASE last WHEN 's' THEN 'max_seeds_budget' WHEN 'p' THEN 'max_postings_budget' ELSE 'none' END AS early_stop_rule
FROM qs LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN made USING (query_id)""",
    "search_max_candidates": _rank_sql() + """, found AS (SELECT r.query_id, o.document_id, o.strand, r.task_rank, r.total, r.n AS own, count(*) AS n, min((r.task_rank, o.document_id, o.position, o.strand)) AS touch
  FROM ranks r JOIN occ o ON o.k = r.k AND o.seed = r.seed GROUP BY r.query_id, o.document_id, o.strand, r.task_rank, r.total, r.n),
cand AS (SELECT query_id, document_id, strand, sum(n * own)::BIGINT AS supporting_seeds, round(sum(n * total), 6) AS score, min(touch) AS touch FROM found GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY touch) AS turn FROM cand)
SELECT query_id, document_id, strand, supporting_seeds, score FROM turns WHERE turn <= 20""",
    "ambiguous_split": """WITH cut AS (SELECT doc_id, substr(s, p + 1, 4) AS word FROM (SELECT doc_id, s, unnest(range(0, length(s) - 3)) AS p FROM (SELECT doc_id, translate(text, 'acgt', 'ACGT') AS s FROM documents))),
seeds AS (SELECT doc_id, least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS seed FROM cut WHERE NOT regexp_matches(word, '[^ACGT]'))
SELECT seed, count(*)::BIGINT AS collection_frequency, count(DISTINCT doc_id)::BIGINT AS document_frequency FROM seeds GROUP BY seed""",
    "noncanonical_kmers": _sql((11,)).replace("least(word, rc) AS seed, (rc < word)::BIGINT AS strand", "word AS seed, 0::BIGINT AS strand") + "SELECT seed, count(*)::BIGINT AS collection_frequency, max(strand) AS strand FROM occ GROUP BY seed",
    "dictionary_semi": _asked_sql() + "SELECT k, seed FROM asked WHERE seed IN (SELECT seed FROM occ)",
    "dictionary_anti": _asked_sql() + "SELECT k, seed FROM asked WHERE seed NOT IN (SELECT seed FROM occ)",
    "posting_fetch": _asked_sql() + "SELECT document_id, count(*)::BIGINT AS postings, min(position) AS first_position FROM occ WHERE seed IN (SELECT seed FROM asked) GROUP BY document_id",
    "index_validate": "SELECT 0::BIGINT AS faults",
    "count_percentiles": "WITH n AS (SELECT list_sort(list(length(regexp_replace(text, '[^ACGTacgt]', '', 'g'))::BIGINT)) AS x FROM documents) SELECT " + ", ".join(f"x[floor({p / 100}::DOUBLE * (len(x) - 1))::BIGINT + 1] AS p{p}" for p in (0, 50, 90, 95, 99, 100)) + ", round(list_avg(x), 6) AS mean FROM n",
    "conservative_stop_flag": "SELECT query_id, max(score) FILTER (WHERE rank = 1) > coalesce(max(score) FILTER (WHERE rank = 2), 0) + coalesce(max(score) FILTER (WHERE rank = 3), 0) AS stop FROM (" + _top_sql(ks=(15,)) + ") WHERE rank <= 3 GROUP BY query_id",
    "base_codes": "SELECT document_id, instr('ACGT', w[1]) - 1 AS code, w[1] AS base, 4 - instr('ACGT', w[1]) AS complement, " + _code_sql("w") + " AS forward_code, " + _code_sql("reverse(translate(w, 'ACGT', 'TGCA'))") + " AS reverse_code, ['rare', 'medium', 'hot', 'very_hot'][document_id % 4 + 1] AS label FROM (SELECT doc_id AS document_id, substr(s, 1, 15) AS w FROM (SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS s FROM documents) WHERE length(s) >= 15)",
}

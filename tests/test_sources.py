"""Files, codecs, the generator and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.functions import codecs
from quern.operators.index import build_index, layer, read_index, validate, write_index
from quern.operators.search import SearchOptions, query_metrics
from quern.sources import sequences as io
from quern.sources import synthetic

REFS = ">doc0_primary\nACGTTGCATGTCGCATGATG\nCATGAGAGCT\n>doc1_reverse_duplicate\nAGCTCTCATGCATCATGCGACATGCAACGT\n\n>doc2_repetitive\nAAAAACCCCCAAAAACCCCCGGGGGTTTTT\n>doc3_ambiguous\nACGTNNNNNNNNACGTACGTACGT\n"
TRUTH = "query_id\tcomparison_stage\texpected_document_ids\tnote\nq0\texact_retrieval\t9\t\nq0\texact_retrieval\t0,1\tx\nq1\texact_retrieval\t\t\n"


@pytest.fixture(scope="module")
def refs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "refs.fa"
    path.write_text(REFS)
    return str(path)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fasta(spark, refs, tmp_path):
    got = _rows(io.read_sequences(spark, refs), "document_id", "sequence_id", "name", "sequence")
    assert [r[:3] for r in got] == [(0, 0, "doc0_primary"), (1, 1, "doc1_reverse_duplicate"), (2, 2, "doc2_repetitive"), (3, 3, "doc3_ambiguous")]
    assert got[0][3] == "ACGTTGCATGTCGCATGATGCATGAGAGCT"
    io.write_fasta(io.read_fasta(spark, refs), str(tmp_path / "out.fa"))
    assert _rows(io.read_fasta(spark, str(tmp_path / "out.fa")), "name", "sequence") == [r[2:] for r in got]


def test_ordinals_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.fa"
    path.write_text("".join(f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = io.read_fasta(spark, str(path))
        assert got.rdd.getNumPartitions() > 3
        assert _rows(got, "document_id", "name", F.length("sequence")) == [(i, f"r{i}", 4 * (i % 7)) for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nameless_records(spark, tmp_path):
    path = tmp_path / "nameless.fa"
    path.write_text(">\nAC\n>b\nGT\n")
    assert _rows(io.read_fasta(spark, str(path)), "document_id", "name", "sequence") == [(0, "b", "ACGT")]
    with pytest.raises(ValueError):
        io.read_fasta(spark, str(path), strict=True)


@pytest.mark.parametrize(
    "text,want",
    [
        ("\n\n>a\nAC\n\nGT\n", [("a", "ACGT")]),
        ("TT\nG\n>a\nAC\n", [("a", "TTGAC")]),
        (">>b\nAC\n>>>c\nG\n", [(">b", "AC"), (">>c", "G")]),
        (">a\nA\n>\nC\n>\nG\n>b\nT\n>\nAAA\n", [("a", "A"), ("b", "CGT")]),
        (">a\n>b", [("a", ""), ("b", "")]),
        (">a x\r\nAC\r\n", [("a x\r", "AC\r")]),
    ],
)
def test_fasta_edges(spark, tmp_path, text, want):
    path = tmp_path / "e.fa"
    path.write_bytes(text.encode())
    assert _rows(io.read_fasta(spark, str(path)), "document_id", "name", "sequence") == [(i, *w) for i, w in enumerate(want)]
    if not text.startswith(("TT", ">a\nA")):
        io.read_fasta(spark, str(path), strict=True).count()


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_fastq_blank_lines(spark, tmp_path, monkeypatch, block):
    """Blank lines where a header is due are skipped, others are lines of the record."""
    monkeypatch.setattr(io, "BLOCK", block)
    path = tmp_path / "b.fq"
    path.write_bytes(b"\n\n@a\nAC\n+\n!!\n\n@b\n\n+\n\n\n\n@c\nG\n+x\n#\n@d\nT\r\n+\n#\r\n\n")
    assert _rows(io.read_sequences(spark, str(path)), "document_id", "name", "sequence") == [(0, "a", "AC"), (1, "b", ""), (2, "c", "G"), (3, "d", "T\r")]


@pytest.mark.parametrize("text,error", [("@a\nAC\n+\n!!\n@b\nGT\n+\n##\n", None), ("@a\nAC\n+\n!\n", "length"), ("@a\nAC\nx\n!!\n", "plus"), ("@a\nAC\n+\n!!\nb\nGT\n+\n##\n", "header"), ("@a\nAC\n", "truncated")])
def test_fastq(spark, tmp_path, text, error):
    path = tmp_path / "q.fq"
    path.write_text(text)
    if error:
        with pytest.raises(ValueError, match=error):
            io.read_sequences(spark, str(path))
    else:
        assert _rows(io.read_sequences(spark, str(path)), "document_id", "name", "sequence") == [(0, "a", "AC"), (1, "b", "GT")]


def test_unknown_format(spark, tmp_path):
    (tmp_path / "x").write_text("ACGT\n")
    with pytest.raises(ValueError):
        io.read_sequences(spark, str(tmp_path / "x"))


def test_truth_and_checksum(spark, tmp_path):
    (tmp_path / "t.tsv").write_text(TRUTH)
    assert {r[0]: r[1] for r in io.read_truth(spark, str(tmp_path / "t.tsv")).collect()} == {"q0": [0, 1], "q1": []}
    (tmp_path / "e").write_bytes(b"a")
    assert io.file_checksum(spark, str(tmp_path / "e")) == f"fnv1a64:{((io.BASIS ^ 97) * io.PRIME) % 2**64:016x}"


def _plain_varint(n):
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_number_codecs(spark):
    lists = [[], [0], [127, 128, 128, 16384], [5, 2**62]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>")
    got = {r[0]: bytes(r[1]) for r in df.select("i", codecs.encode_list(F.col("x"))).collect()}
    for i, x in enumerate(lists):
        assert got[i] == b"".join(map(_plain_varint, [len(x), *(b - a for a, b in zip([0, *x], x))]))
        assert codecs.decode_list(got[i]) == x
    for bad in (b"", b"\x80", b"\x01", b"\x01\x01\x01"):
        with pytest.raises(ValueError):
            codecs.decode_list(bad)
    with pytest.raises(Exception, match="ascending"):
        df.select(codecs.encode_list(F.array(F.lit(2).cast("long"), F.lit(1).cast("long")))).collect()


@pytest.mark.parametrize("per_block", [codecs.PER_BLOCK, 2])
def test_posting_blocks(spark, refs, per_block):
    index = build_index(io.read_fasta(spark, refs), [5, 7], partitions=2)
    blocks = codecs.posting_blocks(index.postings, per_block)
    cols = ("k", "seed", "document_id", "sequence_id", "position", "strand")
    assert _rows(codecs.read_blocks(blocks), *cols) == _rows(index.postings, *cols)
    if per_block > 2:
        sizes = blocks.groupBy("k").agg(F.sum(F.length("data")))
        assert _rows(sizes, *sizes.columns) == [(5, 344), (7, 312)]
    for bad in (b"\x01\x01\x01", b"\x00\x00\x00\x02"):
        with pytest.raises(ValueError):
            codecs.decode_block(bad)


def test_index_tables(spark, refs, tmp_path):
    index = write_index(build_index(io.read_fasta(spark, refs), [5, 7]), str(tmp_path / "i"))
    assert validate(index) == []
    one = read_index(spark, str(tmp_path / "i"), ks=[7], cache=True)
    assert [r["distinct_seeds"] for r in one.describe().collect()] == [39]
    assert _rows(layer(index, 7).dictionary, "seed") == _rows(one.dictionary, "seed")
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "i"), ks=[9])
    queries = spark.createDataFrame([("q", "TGCATGTCGCATGATG")], "query_id string, sequence string")
    r = query_metrics(index, queries, SearchOptions(topk=3, max_candidates=2)).first()
    assert (r["candidates_created"], r["candidates_touched"], r["early_stop_fired"]) == (2, 52, False)
    assert [(x["document_id"], x["supporting_seeds"]) for x in r["topk_results"]] == [(0, 21), (1, 21)]


def test_generator(spark):
    docs = synthetic.documents(spark, 16, 200, seed=3)
    text = {r["document_id"]: r["sequence"] for r in docs.collect()}
    assert text == {r["document_id"]: r["sequence"] for r in synthetic.documents(spark, 16, 200, seed=3).repartition(5).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    assert text[9] == text[8].translate(flip)[::-1] and text[2].startswith(synthetic.BLOCK) and synthetic.UNKNOWN in text[3]
    asked = synthetic.queries(docs, 30, 50, seed=3, mutation=0.1).collect()
    assert len(asked) == 30
    for r in asked:
        n = int(r["query_id"].removeprefix("query"))
        if n % 10 == 0:
            assert r["expected_document_ids"] == [] and set(r["sequence"]) == {"N"}
        elif n % 6 < 4:
            assert any(r["sequence"] in text[d].replace("N", "A") for d in r["expected_document_ids"])


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    assert cli.main(["generate", at("g"), "--documents", "8", "--length", "120", "--queries", "12", "--query-length", "40"]) == 0
    assert cli.main(["build", at("g/refs.fa"), at("i"), "--k", "11"]) == 0
    assert cli.main(["validate", at("i")]) == 0 and "sound" in capsys.readouterr().out
    assert cli.main(["query", at("i"), at("g/queries.fa"), at("t"), "--format", "tsv", "--hot-threshold", "4", "--hot-mode", "doc-only"]) == 0
    table = spark.read.csv(at("t"), sep="\t", header=True)
    assert table.count() == 12 and {"query_id", "seeds_doc_only_hot", "per_k_metrics", "topk_results"} <= set(table.columns)
    assert cli.main(["dump", at("i"), at("d")]) == 0
    assert spark.read.text(at("d")).where("value LIKE 'layer%'").count() == 1
    assert cli.main(["bench", at("g/refs.fa"), at("g/queries.fa"), at("b"), at("o"), "--truth", at("g/truth.tsv"), "--k", "11", "--repeats", "2"]) == 0
    found = json.loads(spark.read.text(at("o/summary")).first()[0])
    assert found["metrics"]["query_runs"] == 24 and found["metrics"]["recall_at_10"] == 1.0 and found["early_stop_mode"] == "off"


def test_damaged_index(spark, refs, tmp_path):
    import glob

    from quern.operators.index import build_index, read_index, write_index

    path = str(tmp_path / "index")
    index = write_index(build_index(io.read_fasta(spark, refs), [5, 7]), path)
    assert index.header()["ks"] == [5, 7] and read_index(spark, path, check=True).ks == [5, 7]
    spark.read.parquet(f"{path}/postings").where("k = 5").limit(1).drop("k").write.mode("append").parquet(f"{path}/postings/k=5")
    with pytest.raises(ValueError, match="postings"):
        read_index(spark, path, check=True)
    with pytest.raises(ValueError, match="without seeds"):
        write_index(build_index(io.read_fasta(spark, refs), [5, 32]), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="family"):
        build_index(io.read_fasta(spark, refs), [5], family="syncmer")
    assert glob.glob(f"{path}/manifest/*")

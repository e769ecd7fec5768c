"""Fingerprints, likeness, edits and the next row against a plain version."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

TABLES = "/root/testdata/sf0.001"
BLANK = "[ \t\n\x0b\f\r]"


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def _leaves(line):
    pattern = merkle.SHORT_LEAF if len(line) < merkle.SHORT else merkle.LEAF
    # blanks are the six ASCII ones
    pattern = pattern.replace(r"[\sa", "[ \\t\\n\\x0b\\f\\ra").replace(r"[^\s", "[^ \\t\\n\\x0b\\f\\r").replace(r"\S", "[^ \\t\\n\\x0b\\f\\r]").replace(r"\s", BLANK)
    return [m[0] for m in re.finditer(pattern, line)]


def _tree(text):
    """``[(digest, [(digest, [leaf digests])])]`` and the written tree."""
    out = []
    for m in re.finditer(r"(?s).+?(?:\n[ \t\r\n]*\n|\Z)", text):
        lines = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", m[0]):
            own = _leaves(line)
            assert "".join(own) == line
            own = [_md5(x) for x in own]
            lines.append((_md5("".join(own)), own))
        out.append((_md5("".join(d for d, _ in lines)), lines))
    w = merkle.WIDTH
    written = "".join(f"{d[:w]}(" + ",".join(".".join([p[:w], *(x[:w] for x in own)]) for p, own in lines) + ")" for d, lines in out)
    return out, hashlib.sha256("".join(d for d, _ in out).encode()).hexdigest() + ":" + written


def _near(a, b):
    if a == b:
        return 1.0
    x, y = ({leaf[: merkle.WIDTH] for _, lines in _tree(t)[0] for _, own in lines for leaf in own} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def _expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for at, (i, text) in enumerate(rows):
        nxt, q = rows[(at + 1) % len(rows)][1], len(text) // 4
        other = text[: len(text) - q] + nxt[:q]
        have = {p for _, lines in _tree(text)[0] for p, _ in lines}
        moved = [j for j, p in enumerate(p for _, lines in _tree(other)[0] for p, _ in lines) if p not in have]
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), _tree(text)[1], _tree(other)[1], pytest.approx(_near(text, other)), pytest.approx(_near(text, nxt)), ",".join(map(str, moved))))
    return out


def _table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op9_merkle_fingerprints(spark, str(tmp_path)).collect()
    return sorted((tuple(r)[:7] + (r["changed_paragraphs"],) for r in out), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


def test_whole_table(spark, tmp_path):
    rows = [tuple(r.values()) for r in pq.read_table(f"{TABLES}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = _table(spark, tmp_path, rows)
    assert got == sorted(_expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
    near = [r[5] for r in got]
    assert sum(near) / len(near) > 0.6 and all(x > 0 for x, r in zip(near, got, strict=True) if r[1] >= 12)


def test_odd_rows(spark, tmp_path):
    draw = random.Random(2)
    rows = [(3, None), (2, ""), (None, "x y\n\n z"), (None, None), (5, "  lead. a b"), (5, "  lead. a b"), (5, "\x01b\n \t\n\n"), (9, "漢字🙂" * 40), (1, "w" * 9000), (4, "".join(draw.choice("ab .\n\t!") for _ in range(4000))), (8, "word " * 30000), (7, "\n" * 500)]
    assert _table(spark, tmp_path, rows) == sorted(_expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(i, f"t{i}", 1, 2, 3, 4, 5) for i in range(30)], "doc_id long, text string, _k int, _at int, _p int, _tree int, next int")
    out = merkle.with_fingerprint(merkle.with_next(df, "doc_id", "text", 1), "text", "fp")
    assert [(r["next"], r["_k"], r["_at"], r["_p"], r["_tree"]) for r in out.orderBy("doc_id").collect()] == [(f"t{(i + 1) % 30}", 1, 2, 3, 4) for i in range(30)]
    assert merkle.with_next(df.limit(0), "doc_id", "text").count() == 0


def test_only_the_edit_is_reported(spark):
    """Separators count, and an inserted section does not mark those after it."""
    one = "a b.\n\nc d.\n\ne f."
    texts = {"same": one, "blank": "a b.\n \nc d.\n\ne f.", "lead": " " + one, "more": "new.\n\n" + one}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "text", "fp").withColumn("one", F.lit(one)), "one", "base")
    out = {r["name"]: r for r in df.select("*", merkle.changed_sections(F.col("fp"), F.col("base")).alias("s"), (F.substring("fp", 1, 64) == F.substring("base", 1, 64)).alias("eq")).collect()}
    assert {k: (r["eq"], r["s"]) for k, r in out.items()} == {"same": (True, []), "blank": (False, [0]), "lead": (False, [0]), "more": (False, [0])}

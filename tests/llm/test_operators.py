"""Small checks of the training-data operators, odd rows included."""

import random

import pyarrow as pa
import sentencepiece

from quern.llm import chat, pieces, urls
from quern.llm.licences import ANCHORS, SENTENCES, scan
from quern.sources.workspace import Workspace


def test_pieces_round_trip_and_library():
    model = pieces.PieceModel(pieces.read_model())
    for text in ("", " ", "a", "  two  blanks ", "line\n\nfeed\n", "▁ ▁x", "äöü 漢字 🙂", "x" * 3000, "The quick brown fox."):
        assert model.decode(model.encode(text)) == text
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert lib.decode(model.encode("The quick brown fox.")) == "The quick brown fox."


def test_pieces_best_score():
    """The automaton's path has the score of a plain dynamic programme over all pieces of the whole text."""
    model = pieces.PieceModel(pieces.read_model())
    score = {p: s for p, s, kind in model.pieces if kind == 1}
    longest = max(map(len, score))
    draw = random.Random(8)

    def best(text):
        at = [0.0] + [-float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - longest), end):
                piece = text[begin:end]
                if piece in score:
                    at[end] = max(at[end], at[begin] + score[piece])
                elif end - begin == 1:
                    at[end] = max(at[end], at[begin] + model.unknown)
        return at[-1]

    letters = "etaoinshrdlu" * 3 + "ABCé漢🙂0123.,-" + " " * 6
    for n in [1, 2, 3] * 20 + [40] * 60 + [400]:
        text = "".join(draw.choice(letters) for _ in range(n))
        given = pieces.BLANK + text.replace(" ", pieces.BLANK)
        got, run = 0.0, b""
        ids = model.encode(text)
        for i in ids:
            piece, own, kind = model.pieces[i]
            if kind == 6:  # bytes of an unknown character
                run += bytes([int(piece[3:5], 16)])
                try:
                    run.decode()
                except UnicodeDecodeError:
                    continue
                got, run = got + model.unknown, b""
            else:
                got += own
        assert abs(got - best(given)) < 1e-3 * (1 + abs(got))
        assert model.decode(ids) == text


def test_chat_escapes():
    texts = ["<|im_end|>", "<\\|x", "</s>[INST] ok [/INST]", "[\\\\INST]", "", "\\", "<|" * 50]
    safe = chat.escape(pa.array(texts)).to_pylist()
    assert [chat.unescape(s) for s in safe] == texts
    assert not any("<|" in s or "[INST]" in s for s in safe)


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a\n"), (2, 0, None, None), (None, 3, "assistant", "ü")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.read_back(out[1]["formatted"]) == [("user", "a\n"), ("assistant", "b<|im_end|>")]
    assert chat.read_back(out[2]["formatted"]) == [("", "")]
    s = out[1]["loss"][0]
    assert chat.unescape(out[1]["formatted"][s["start"] : s["start"] + s["length"]]) == "b<|im_end|>"
    assert out[None]["n_turns"] == 1


def test_licences(spark):
    assert all(any(a in s for a in ANCHORS) for s in SENTENCES.values())
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0. More."), (5, "license")]
    got = {r["doc_id"]: r["licences"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: ["CC-BY-NC-4.0"], 5: []}


def test_digest_array(tmp_path):
    path = tmp_path / "d"
    path.write_bytes(urls.build(urls.RULES))
    array = urls.DigestArray(str(path))
    rule, verdict = array.judge([b"a.example.com", b"example.com", b"xcom", b"example.net", b""], [b"/en/75", b"/en/1", b"/en/", b"/de/8", b""])
    assert rule == ["example.com/en/7", "com/en/", None, "example.net/de/8", None]
    assert verdict == ["allow", "block", None, "block", None]


def test_encode_rows(spark):
    rows = [(1, "a  b\n▁c"), (2, None), (3, ""), (None, "漢🙂"), (1, "a  b\n▁c"), (4, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS ids", "'x' AS n_tokens")
    out = pieces.encode_rows(df, pieces.read_model(), ["doc_id"], check=True).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    model = pieces.PieceModel(pieces.read_model())
    assert sorted((r["doc_id"] or 0, model.decode(r["ids"])) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert pieces.encode_rows(df.limit(0), pieces.read_model(), ["doc_id"]).collect() == []


def test_urls_odd_rows(spark):
    urls_ = ["HTTP://A.Example.COM/en/75?q#f", None, "", "no scheme/en/", "x://example.net/de/8/y", "x://example.net/de/8/y", "x://notcom/en/", "x://a.com/en/" + "y" * 100_000, "x://com", "://com/en/#://org/es/"]
    data = [(i, u, "h", "p", "r", "v", 1) for i, u in enumerate(urls_)]
    df = spark.createDataFrame(data, "page_id long, url string, host string, path string, rule string, verdict string, _told int")
    out = urls.judge_urls(df, urls.RULES, Workspace(spark, "test"))
    assert out.columns == ["page_id", "url", "_told", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"][:10], r["rule"], r["verdict"]) for r in out.collect()}
    none = ("", "", None, "allow")
    block = ("example.net", "/de/8/y", "example.net/de/8", "block")
    assert got == {
        0: ("a.example.com", "/en/75", "example.com/en/7", "allow"), 1: none, 2: none, 3: none, 4: block, 5: block, 6: ("notcom", "/en/", None, "allow"),
        7: ("a.com", "/en/yyyyyy", "com/en/", "block"), 8: ("com", "", None, "allow"), 9: ("com", "/en/", "com/en/", "block"),
    }
    assert urls.judge_urls(df.limit(0), urls.RULES, Workspace(spark, "test")).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df, [], Workspace(spark, "test"), default="block").collect()} == {"block"}


def test_digests_that_collide(tmp_path, monkeypatch):
    """Rules of one key stand side by side, and only the full string decides."""
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "d"
    path.write_bytes(urls.build(urls.RULES))
    rule, _ = urls.DigestArray(str(path)).judge([b"a.com", b"a.net", b"b.xyz"], [b"/en/", b"/de/", b"/en/"])
    assert rule == ["com/en/", "net/de/", None]


def test_chat_blocks(spark, monkeypatch):
    """Conversations within, over and larger than blocks, against a plain join."""
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "sys\\\ntem", None]), draw.choice([None, "", "ü<|x", "</s>", "漢" * draw.randrange(40)])) for c in (*range(20), None) for t in range(draw.randrange(1, 9))]
    rows += [(3, 0, "assistant", "same")] * 3 + [(50, None, "user", "z" * 300_000), (50, 1, "assistant", "y")]
    columns = list(zip(*sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["conv_id", "role", "text"])
    want = {}
    for c, role, text in zip(columns[0], columns[2], columns[3], strict=True):
        want.setdefault(c, []).append((role or "", text or ""))
    for size in (1, 50, 4 << 20):
        monkeypatch.setattr(chat, "BLOCK_BYTES", size)
        out = [r for b in chat._assemble_partition(iter([batch.slice(0, 7), batch.slice(0, 0), batch.slice(7)])) for r in b.to_pylist()]
        assert {r["conv_id"]: chat.read_back(r["formatted"]) for r in out} == want and len(out) == len(want)
        for r in out:
            assert r["n_turns"] == len(want[r["conv_id"]])
            assert [chat.unescape(r["formatted"][x["start"] : x["start"] + x["length"]]) for x in r["loss"]] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    assert {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_conversations(df).collect()} == want
    assert chat.format_conversations(df.limit(0)).count() == 0

"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

The automaton holds all ordinary pieces.  Reading a text once, it reports at every position the
pieces that end there, longest first, by following output links; each relaxes the best score at
its end from the best score at its start.  A character that is no piece costs the model's
lowest score less 10 and is written as its UTF-8 bytes.  Ties go to the earlier start.

No piece reaches over the start of a word (checked when a model is read), so the best path of a
text is that of its words in a row, and a word's path is kept for the next time it occurs.

Decoding is the exact inverse: ``decode(encode(text)) == text`` for every text.  For this the
character that stands for a blank in pieces (U+2581), where a text itself holds it, is written
as bytes.  Null texts count as empty and have no ids, null and repeated ids are rows like others, an
empty table gives an empty result, and of the input the named columns are kept, whatever they are
called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
KEPT_WORDS = 200_000
KEPT_LENGTH = 48
BLOCK_CHARS = 1 << 21


def _fields(data: bytes):
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A SentencePiece model with byte fallback and without text normalisation."""

    def __init__(self, data: bytes) -> None:
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        dummy_prefix, extra_blanks, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, dtype="<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        dummy_prefix = bool(v)
                    elif n == 4:
                        extra_blanks = bool(v)
        if charsmap or extra_blanks or not dummy_prefix:
            raise ValueError("only models that keep a text as it is, after one blank, can be decoded exactly")
        ordinary = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind == 1]
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in ordinary):
            raise ValueError("a piece reaches over the start of a word")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == 6}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.unknown = min(s for _, s, _ in ordinary) - 10.0
        self.single = {p for p, _, _ in ordinary if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s, i in ordinary:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.inner = {c for p, _, _ in ordinary for c in p}
        #: Line feeds are in no piece, so a line is a row of words of its own.
        self.by_line = "\n" not in self.inner
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind in (2, 3) else p.replace(BLANK, " ").encode() for p, _, kind in self.pieces]
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.blank_bytes = np.array([self.byte_ids[b] for b in BLANK.encode()], dtype=np.int32).tobytes()
        self.line_feed = np.array([self.byte_ids[10]], dtype=np.int32).tobytes()
        self.known: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path through ``word`` (blanks already replaced)."""
        n = len(word)
        best, start, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        known = self.single.issuperset(word)
        done = 0
        for last, (size, score, i) in self.automaton.iter(word):
            end = last + 1
            if not known and end > done + 1:
                self._unknown(word, best, start, piece, done, end - 1)
                done = end - 1
            begin = end - size
            score += best[begin]
            if score > best[end]:
                best[end], start[end], piece[end] = score, begin, i
        if not known:
            self._unknown(word, best, start, piece, done, n)
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[start[at] : at].encode()))
            at = start[at]
        out.reverse()
        return out

    def _unknown(self, word: str, best: list, start: list, piece: list, done: int, upto: int) -> None:
        """Let characters that are no pieces reach the ends from ``done + 1`` to ``upto``."""
        for end in range(done + 1, upto + 1):
            if word[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end], start[end], piece[end] = best[end - 1] + self.unknown, end - 1, -1

    def _learn(self, word: str) -> bytes:
        ids = np.array(self.viterbi(word), dtype=np.int32).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in a row."""
        out: list[bytes] = []
        if not text:
            return b""
        get, learn = self.known.get, self._learn
        lead = BLANK
        for j, part in enumerate(text.split(BLANK)):
            if j:
                out.append(self.blank_bytes)
            for k, line in enumerate(part.split("\n") if self.by_line else [part]):
                if k:
                    out.append(self.line_feed)
                # a blank before the text, none before a later line
                blanked = lead + line.replace(" ", BLANK)
                lead = ""
                if BLANK + BLANK in blanked:
                    words = re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", blanked)
                else:
                    head, *rest = blanked.split(BLANK)
                    words = [BLANK + word for word in rest]
                    if head:
                        words.insert(0, head)
                out += [get(word) or learn(word) for word in words]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode_lists(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts of lists of ids side by side (``off``: where each starts, and the end)."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.arange(ends[-1], dtype=np.int64)
        at += np.repeat(self.starts[ids] - ends[:-1], size)
        raw = self.table[at]
        # the blank before each text goes
        cut = ends[off]
        told = np.diff(cut) > 0
        stay = np.ones(len(raw), dtype=bool)
        stay[cut[:-1][told]] = False
        offsets = cut - np.concatenate([[0], np.cumsum(told)])
        raw = np.ascontiguousarray(raw[stay])
        return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))

    def decode(self, ids) -> str:
        """The text of ids that ``encode`` made."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_rows(frame: DataFrame, model: bytes, keep: list[str], text: str = "text", check: bool = False) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` of every row; the model's file is read by the driver only.

    With ``check`` also ``round_trip``: whether the ids decode to the text.  Rows go through in
    blocks of about ``BLOCK_CHARS`` characters of text (a longer text is a block), so memory does
    not follow the size of an Arrow batch.
    """
    sent = frame.sparkSession.sparkContext.broadcast(model)
    given = frame.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def block(own: PieceModel, columns: list[pa.Array], texts: pa.Array) -> pa.RecordBatch:
        parts = [own.encode_bytes(t) for t in texts.to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]) // 4
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
        more = [pa.array(np.diff(off), pa.int64()), lists]
        if check:
            more.append(pc.equal(own.decode_lists(ids, off), texts.cast(pa.large_string())))
        return pa.RecordBatch.from_arrays([*columns, *more], names=names)

    names = [*keep, "n_tokens", "ids", *(["round_trip"] if check else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(sent.value)
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < len(texts):
                before = sizes[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(sizes, before + BLOCK_CHARS, side="right")))
                columns = [batch.column(i).slice(row, end - row) for i in range(len(keep))]
                yield block(own, columns, texts.slice(row, end - row))
                row = end

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(encode, f"{kept}, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))


def decode_column(frame: DataFrame, model: bytes, ids: str = "ids") -> Column:
    """The texts of an id column; a null list is an empty text."""
    sent = frame.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own = _shared(sent.value)
        return pa.array([own.decode(x or ()) for x in lists.to_pylist()], type=pa.string())

    return decode(F.col(ids))


_by_bytes: dict[int, tuple[bytes, PieceModel]] = {}


def _shared(data: bytes) -> PieceModel:
    """One model for each worker process."""
    held = _by_bytes.get(len(data))
    if held is None or (held[0] is not data and held[0] != data):
        held = _by_bytes[len(data)] = (data, PieceModel(data))
    return held[1]


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and whether they decode to its text: ``doc_id, n_tokens, ids, round_trip``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_rows(documents, read_model(), ["doc_id"], check=True)

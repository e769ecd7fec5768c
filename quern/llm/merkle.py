"""Merkle fingerprints of documents, with DataFrame operations only.

A text is a row of sections (each up to and with its blank lines), a section a row of paragraphs
(lines with their line feed), a paragraph a row of leaves.  A leaf is up to ``LEAF_WORDS`` words
with the blanks after them and ends with a sentence; long words and paragraphs of few characters
are cut after certain letters, so an edit moves no cut far from it.  Every code point is in a
leaf.  A node's digest is that of its children's digests, so equal roots mean equal texts, and
where roots differ the branches that differ lead to the edit (``changed_sections``,
``changed_paragraphs``: branches that the other tree does not have, wherever they stand).

A fingerprint is written as ``root:section(paragraph.leaf.leaf,...)...``, digests below the root
by their first ``WIDTH`` digits.  The likeness of two fingerprints is 1 for equal roots and else
twice the distinct leaves that they have in common over the distinct leaves of both.

Null texts count as empty; an empty text has no leaf, and its fingerprint is the root of no
section.  Texts of the same characters have the same fingerprint, whatever their rows.  Long texts
are taken whole.  Rows that repeat an id follow each other by their text, null ids come first.  An
empty table gives an empty result.  Input columns that are named like an added one are replaced,
all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.labelled import fresh

LEAF_WORDS = 4
WIDTH = 12
SECTION = r"(?s).+?(?:\n[ \t\r\n]*\n|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
#: Words up to the end of a sentence, pieces of a long word, or blanks.
LEAF = r"(?:\S{0,22}[^\s.!?](?!\S)\s*){0,%d}\S{1,23}(?!\S)\s*|\S{8,31}?[aeiou02468]\s*|\S{1,32}\s*|\s+" % (LEAF_WORDS - 1)
#: Leaves of a paragraph of fewer than ``SHORT`` characters.
SHORT, SHORT_LEAF = 48, r"(?s).{2,7}?[\saeinorst]|.{1,8}"
SLICE_ROWS = 2000
MOST_SLICES = 16384


def _digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sections(text: Column) -> Column:
    """``d`` (digest) and ``w`` (written branch) of all sections, in order."""
    brief = lambda d: F.substring(d, 1, WIDTH)
    leaves = lambda p: F.transform(F.when(F.length(p) < SHORT, _cut(p, SHORT_LEAF)).otherwise(_cut(p, LEAF)), _digest)
    joined = lambda row: F.concat_ws("", row)
    # a node's digest is made once and then written
    own = lambda row: F.struct(_digest(joined(row)).alias("d"), F.concat_ws(".", F.transform(row, brief)).alias("w"))
    paragraph = lambda n: F.struct(n["d"].alias("d"), F.concat(brief(n["d"]), F.lit("."), n["w"]).alias("w"))
    lines = lambda s: F.transform(F.transform(F.transform(_cut(s, PARAGRAPH), leaves), own), paragraph)
    above = lambda row: F.struct(_digest(joined(row["d"])).alias("d"), F.concat_ws(",", row["w"]).alias("w"))
    section = lambda n: F.struct(n["d"].alias("d"), F.concat(brief(n["d"]), F.lit("("), n["w"], F.lit(")")).alias("w"))
    return F.transform(F.transform(F.transform(_cut(text, SECTION), lines), above), section)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the written tree of ``text`` as ``name``."""
    tree = fresh(rows.columns, "_tree")
    rows = rows.withColumn(tree, sections(F.coalesce(F.col(text), F.lit(""))))
    root = F.sha2(F.concat_ws("", F.col(tree)["d"]).cast("binary"), 256)
    return rows.withColumn(name, F.concat(root, F.lit(":"), F.concat_ws("", F.col(tree)["w"]))).drop(tree)


def leaf_set(written: Column) -> Column:
    """The distinct leaves of a written tree."""
    return F.array_distinct(F.regexp_extract_all(written, F.lit(r"\.([0-9a-f]{%d})" % WIDTH), F.lit(1)))


def likeness(a: Column, leaves_a: Column, b: Column, leaves_b: Column) -> Column:
    """0 to 1 for two written trees and their leaves."""
    total = F.size(leaves_a) + F.size(leaves_b)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / total)


def _positions(a: Column, b: Column, branch: str) -> Column:
    of = lambda w: F.regexp_extract_all(w, F.lit(branch % WIDTH), F.lit(1))
    missing = F.array_except(of(a), of(b))
    return F.filter(F.transform(of(a), lambda d, i: F.when(F.array_contains(missing, d), i)), lambda i: i.isNotNull())


def changed_sections(a: Column, b: Column) -> Column:
    """Places, from 0, of the sections of ``a`` that ``b`` does not have."""
    return _positions(a, b, r"[:)]([0-9a-f]{%d})\(")


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Places, from 0, of the paragraphs of ``a`` that ``b`` does not have."""
    return _positions(a, b, r"[(,]([0-9a-f]{%d})\.")


def with_next(documents: DataFrame, id_col: str, text_col: str, slice_rows: int = SLICE_ROWS, most: int = MOST_SLICES) -> DataFrame:
    """Add ``next``: the text of the following row by (id, text), the first row's after the last.

    Rows are dealt to slices between ids that occur, so a row's neighbour is in its slice or is
    the first of the next, of which each slice gets a copy.  The driver holds one number for each
    of at most ``most`` slices, and a row finds its slice by halving.  Null ids come first; rows
    of one id are in one slice.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    ids = documents.select(key.alias("k"))
    n, least = ids.agg(F.count("*"), F.min("k")).first()
    cuts = min(most, max(1, n // slice_rows))
    marks = ids.agg(F.percentile_approx("k", [i / cuts for i in range(cuts)], 20 * cuts)).first()[0] if n else []
    bounds = sorted({least, *marks}) if n else [0]
    listed = F.lit(bounds).cast("array<long>")
    steps = [1 << i for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    k, at, p = (fresh([*documents.columns, "next"], c) for c in ("_k", "_at", "_p"))
    beyond = lambda lo, step: (lo + step < len(bounds)) & (F.get(listed, lo + step) <= F.col(k))
    halved = F.aggregate(F.lit(steps), F.lit(0), lambda lo, step: F.when(beyond(lo, step), lo + step).otherwise(lo))
    rows = documents.withColumn(k, key).withColumn(at, halved)
    home = F.struct(F.col(at).alias("at"), F.lit(False).alias("guest"))
    away = F.struct(F.pmod(F.col(at) - 1, F.lit(len(bounds))).alias("at"), F.lit(True).alias("guest"))
    rows = rows.withColumn(p, F.explode(F.when(F.get(listed, F.col(at)) == F.col(k), F.array(home, away)).otherwise(F.array(home))))
    follow = F.lead(F.col(text_col), 1).over(Window.partitionBy(F.col(p)["at"]).orderBy(F.col(p)["guest"], k, F.col(text_col)))
    return rows.withColumn("next", follow).where(~F.col(p)["guest"]).drop(k, at, p)


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many first characters of another."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def op9_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, how alike they and the next document's are, and where the edit is."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # only texts are shuffled: a tree is quickly made again
    rows = with_next(documents, "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next")))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next", "next_fingerprint")):
        rows = with_fingerprint(rows, text, name)
    rows = rows.withColumn("x", leaf_set(F.col("fingerprint"))).withColumn("y", leaf_set(F.col("edited_fingerprint"))).withColumn("z", leaf_set(F.col("next_fingerprint")))
    near = {name: likeness(F.col("fingerprint"), F.col("x"), F.col(f"{name}_fingerprint"), F.col(leaf)).alias(f"near_{name}") for name, leaf in (("edited", "y"), ("next", "z"))}
    changed = [F.array_join(f(F.col("edited_fingerprint"), F.col("fingerprint")).cast("array<string>"), ",").alias(name) for f, name in ((changed_sections, "changed_sections"), (changed_paragraphs, "changed_paragraphs"))]
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near["edited"], near["next"], *changed)

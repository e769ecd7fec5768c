"""URL filter over a sorted digest array.

Rules (host, path, verdict) are one file: the 64-bit xxhash keys of ``host + path`` in ascending
order, the full rule strings behind them, and the same for rule hosts with the path lengths that
each host has.  The file is written once to the shared folder, fetched once by each executor
through Spark, and memory-mapped, so workers of an executor share its pages.  A batch probes
every suffix of its hosts by one vectorised binary search, then, for hosts that have rules, the
path lengths that they have; a hit counts only if the stored string equals the probed one.

The longest fitting rule wins; of equally long ones that with the longer host.  A url that no
rule fits gets the filter's default.  Null urls, and urls without ``://``, have empty host and
path, which no rule fits.  Empty tables and empty rule lists are allowed, urls of any length are
judged whole, and repeated rows each for itself.  Input columns that are named like an added one
are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import fresh
from quern.sources.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MAX_RULES = 20_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _strings(values: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int64), b"".join(values)


def build(rules: Iterable[tuple[str, str, str]], max_rules: int = MAX_RULES) -> bytes:
    """The digest file of at most ``max_rules`` rules; a rule given twice keeps its last verdict.

    Strings that share a key stand side by side.
    """
    verdict: dict[tuple[bytes, bytes], int] = {}
    for host, path, word in rules:
        if word not in ("allow", "block"):
            raise ValueError(f"no such verdict: {word}")
        verdict[host.translate(str.maketrans(UPPER, LOWER)).encode(), path.encode()] = int(word == "block")
        if len(verdict) > max_rules:
            raise ValueError(f"more than {max_rules} rules")
    lengths: dict[bytes, set[int]] = {}
    for host, path in verdict:
        lengths.setdefault(host, set()).add(len(path))
    rows = sorted((xxhash.xxh64_intdigest(h + p), h + p, len(h), v) for (h, p), v in verdict.items())
    hosts = sorted((xxhash.xxh64_intdigest(h), h, sorted(n)) for h, n in lengths.items())
    rule_off, rule_text = _strings([r[1] for r in rows])
    host_off, host_text = _strings([h[1] for h in hosts])
    n_off = np.concatenate([[0], np.cumsum([len(h[2]) for h in hosts], dtype=np.int64)]).astype(np.int64)
    sections = [
        np.array([r[0] for r in rows], dtype=np.uint64), rule_off, np.array([2 * r[2] + r[3] for r in rows], dtype=np.int64),
        np.array([h[0] for h in hosts], dtype=np.uint64), host_off, n_off, np.array([n for h in hosts for n in h[2]], dtype=np.int64),
    ]
    raw = [s.tobytes() for s in sections] + [rule_text, host_text]
    return struct.pack("<9q", *(len(r) for r in raw)) + b"".join(raw)


class DigestArray:
    """A digest file, memory-mapped."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = struct.unpack("<9q", data[:72].tobytes())
        at = np.concatenate([[72], 72 + np.cumsum(sizes)])
        part = [data[at[i] : at[i + 1]] for i in range(9)]
        # views, not copies: pages are read as they are probed
        self.keys, self.off, self.told = part[0].view(np.uint64), part[1].view(np.int64), part[2].view(np.int64)
        self.host_keys, self.host_off, self.n_off, self.lengths = part[3].view(np.uint64), part[4].view(np.int64), part[5].view(np.int64), part[6].view(np.int64)
        self.text, self.host_text = part[7], part[8]

    @staticmethod
    def _confirmed(keys: np.ndarray, off: np.ndarray, text: np.ndarray, probes: list[bytes]) -> np.ndarray:
        """Index of each probed string, or -1."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not len(keys) or not probes:
            return out
        digest = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(keys, digest)
        hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == digest)
        for i in hit:
            j = at[i]
            while j < len(keys) and keys[j] == digest[i]:
                if text[off[j] : off[j + 1]].tobytes() == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> tuple[list[str | None], list[str | None]]:
        """The winning rule and verdict of each url, None where no rule fits."""
        suffixes: dict[bytes, int] = {}
        of_host: dict[bytes, list[int]] = {}
        for host in set(hosts):
            of_host[host] = own = []
            at = 0
            while host:
                own.append(suffixes.setdefault(host[at:], len(suffixes)))
                at = host.find(b".", at) + 1
                if not at:
                    break
        listed = list(suffixes)
        found = self._confirmed(self.host_keys, self.host_off, self.host_text, listed)
        lengths = {i: self.lengths[self.n_off[j] : self.n_off[j + 1]].tolist() for i, j in enumerate(found) if j >= 0}
        probes: dict[bytes, int] = {}
        wanted: list[list[tuple[int, int]]] = []
        for host, path in zip(hosts, paths, strict=True):
            own = []
            for i in of_host[host]:
                for n in lengths.get(i, ()):
                    if n <= len(path):
                        own.append((len(listed[i]), probes.setdefault(listed[i] + path[:n], len(probes))))
            wanted.append(own)
        text = list(probes)
        found = self._confirmed(self.keys, self.off, self.text, text)
        rule, verdict = [], []
        for own in wanted:
            # the stored split between host and path has to be the probed one
            fits = [(len(text[p]), h, p) for h, p in own if found[p] >= 0 and self._split(found[p], h)]
            if fits:
                _, h, p = max(fits)
                rule.append(text[p].decode())
                verdict.append("block" if self.told[found[p]] & 1 else "allow")
            else:
                rule.append(None)
                verdict.append(None)
        return rule, verdict

    def _split(self, j: int, host_length: int) -> bool:
        return int(self.told[j]) >> 1 == host_length


_open: dict[str, DigestArray] = {}


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], ws: Workspace, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``; other columns stay in the JVM."""
    data = build(rules)
    # a session registers a file name once, and this call's file lies in this call's folder
    name = f"digests-{hashlib.sha256(ws.root.encode() + data).hexdigest()[:16]}.bin"
    pages.sparkSession.sparkContext.addFile(ws.write_bytes(name, (data[i : i + (1 << 20)] for i in range(0, len(data), 1 << 20))))

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def judged(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        array = _open.get(name)
        if array is None:
            _open.clear()
            array = _open[name] = DigestArray(SparkFiles.get(name))
        for host, path in pairs:
            rule, verdict = array.judge(host.cast(pa.binary()).to_pylist(), path.cast(pa.binary()).to_pylist())
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    names = []
    for c in ("_host", "_path", "_told"):
        names.append(fresh([*pages.columns, *names], c))
    h, p, t = names
    told = pages.withColumn(h, host_of(F.col(url))).withColumn(p, path_of(F.col(url))).withColumn(t, judged(h, p))
    added = {"host": F.col(h), "path": F.col(p), "rule": F.col(t)["rule"], "verdict": F.coalesce(F.col(t)["verdict"], F.lit(default))}
    return told.select(*(F.col(f"`{c}`") for c in pages.columns if c not in added), *(e.alias(c) for c, e in added.items()))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict: ``page_id, host, path, rule, verdict``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, Workspace(spark, "urls")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = []
    for host, path, verdict in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    word = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {word} ELSE 'allow' END AS verdict FROM cut
"""


OP1_SQL = _sql()

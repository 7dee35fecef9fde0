"""URL filter: host/path rules in a sorted digest array.

The rules' 64-bit xxhash keys lie sorted in one array beside their full strings.
Both are files that Spark ships to every executor; tasks memory-map them, so the
workers of an executor share one copy. Every host suffix and path prefix of a url
is a candidate key: a batch of them is probed by one vectorised binary search,
and a hit counts only when the stored string equals the candidate.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import read

#: The most rules one digest array takes (about 100 bytes each on an executor).
MAX_RULES = 20_000_000
SCHEMA = ("page_id long, host string, path string, rule string, verdict string")


def write_digests(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Write ``path``: sorted keys, string offsets, verdicts and strings of the
    (rule, verdict) pairs. Of repeated rules one stays, ``block`` before ``allow``."""
    verdicts: dict[str, str] = {}
    for rule, verdict in rules:
        if rule is None or verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"rule {rule!r} with verdict {verdict!r}: need host/path and allow or block")
        host, slash, tail = rule.partition("/")
        rule = host.lower() + slash + tail
        if verdicts.get(rule) != "block":
            verdicts[rule] = verdict
    texts = [r.encode() for r in verdicts]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0] + [len(texts[i]) for i in order]).astype(np.int64)
    lengths = np.array(sorted({len(t) - t.index(b"/") for t in texts}), np.int64)
    with open(path, "wb") as f:
        np.array([len(texts), len(lengths)], np.int64).tofile(f)
        lengths.tofile(f)
        keys[order].tofile(f)
        ends.tofile(f)
        np.array([list(verdicts.values())[i] == "block" for i in order], np.uint8).tofile(f)
        f.write(b"".join(texts[i] for i in order))


class Digests:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.int64))
        at = 16
        self.path_lengths = [int(x) for x in raw[at:at + 8 * m].view(np.int64)]
        at += 8 * m
        self.keys = raw[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at:at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.block = raw[at:at + n]
        self.blob = raw[at + n:]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate's rule, or -1; equal keys of other strings
        are told apart by the stored strings."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        keys = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        lo = np.searchsorted(self.keys, keys, "left")
        hi = np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):
                if self.blob[self.ends[j]:self.ends[j + 1]].tobytes() == candidates[i]:
                    found[i] = j
        return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see the module's query contract; without ``://`` both empty."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host, slash, tail = rest.partition("/")
    return host.translate(_LOWER), slash + tail


def candidates(host: str, path: str, path_lengths: list[int]) -> Iterator[bytes]:
    """host suffixes at label borders x path prefixes of the rules' lengths."""
    if not host or not path:
        return
    raw = path.encode()
    heads = [raw[:n] for n in path_lengths if n <= len(raw)]
    while heads:
        for head in heads:
            yield host.encode() + head
        _, dot, host = host.partition(".")
        if not dot:
            return


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict).

    ``rules``: (rule, verdict) pairs or a DataFrame of them; ``rule`` is
    ``host/path``. A rule fits its host and all subdomains if the url's path
    starts with the rule's path; the longest fitting rule wins (ties: the longer
    host). No rule: null and ``default``. A null or malformed url has empty host
    and path and gets the default; rows, ids and urls may repeat or be null, and
    an empty table gives an empty result. More than ``max_rules`` rules raise.
    """
    spark: SparkSession = pages.sparkSession
    if isinstance(rules, DataFrame):
        rows = rules.select("rule", "verdict").limit(max_rules + 1).toLocalIterator()
        rules = [(r[0], r[1]) for r in rows]
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; one digest array takes {max_rules}")
    name = f"digests-{uuid.uuid4().hex}"
    # the driver serves the file to executors, late ones too, so it stays until the driver ends
    folder = os.path.realpath(tempfile.mkdtemp(prefix="digests-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    write_digests(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))

    def run(batches):
        digests = Digests(SparkFiles.get(name))
        for batch in batches:
            yield _judge_batch(batch, digests, default)

    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                       F.col(f"`{url_col}`").cast("string").alias("url"))
    return src.mapInArrow(run, SCHEMA)


def _judge_batch(batch: pa.RecordBatch, digests: Digests, default: str) -> pa.RecordBatch:
    parts = [split_url(u) for u in batch.column(1).to_pylist()]
    probe: list[bytes] = []
    owner: list[int] = []
    hosts: list[int] = []
    for i, (host, path) in enumerate(parts):
        for c in candidates(host, path, digests.path_lengths):
            probe.append(c)
            owner.append(i)
            hosts.append(c.index(b"/"))
    best: list[tuple[int, int, int] | None] = [None] * len(parts)
    found = digests.find(probe)
    for k in np.flatnonzero(found >= 0):
        rank = (len(probe[k]), hosts[k], int(found[k]))
        if best[owner[k]] is None or rank > best[owner[k]]:
            best[owner[k]] = rank
    rule = [None if b is None else digests.blob[digests.ends[b[2]]:digests.ends[b[2] + 1]].tobytes().decode()
            for b in best]
    verdict = [default if b is None else "block" if digests.block[b[2]] else "allow" for b in best]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
         pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
        names=["page_id", "host", "path", "rule", "verdict"])


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES)


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM p),
h AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw_host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM q),
l AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
rules(rule, rhost, rpath, rverdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rule, rverdict FROM l JOIN rules
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS verdict
      FROM m GROUP BY ALL)
SELECT l.page_id, l.host, l.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM l LEFT JOIN b ON l.page_id = b.page_id AND l.host = b.host AND l.path = b.path
"""

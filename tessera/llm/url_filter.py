"""URL filter over a sorted array of 64-bit digests.

The rules' keys (host and path prefix) are hashed with xxhash64 and stored in one file: digests in order, verdicts,
and the full keys. Every executor fetches that file once and maps it into memory. A url's candidate keys, each suffix
of its host at a label's start with each path prefix as long as some rule's, are probed with one vectorised binary
search per batch; a digest that is found counts only if the stored key is the candidate.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

_MAGIC = b"TSDIGEST"
VERDICTS = ("block", "allow")
#: The file goes to every executor, so its size is checked.
MAX_INDEX_BYTES = 4 << 30


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host is what follows the first :// up to / ? # or the end, A-Z lower-cased; path what follows up to ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def index_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """The digest file of rules (host, path, verdict). Of rules with the same host and path the first counts.

    Layout: magic, four counts (rules, path lengths, key bytes, none), digests, key offsets, path lengths, verdicts, keys.
    """
    unique: dict[bytes, tuple[str, str, str]] = {}
    for host, path, verdict in rules:
        unique.setdefault(f"{host}\0{path}".encode(), (host, path, verdict))
    keyed = sorted((xxhash.xxh64_intdigest(key), key, rule) for key, rule in unique.items())
    keys = [key for _, key, _ in keyed]
    lengths = sorted({len(path) for _, path, _ in unique.values()})
    parts = [
        np.array([len(keyed), len(lengths), sum(map(len, keys)), 0], np.int64),
        np.array([digest for digest, _, _ in keyed], np.uint64),
        np.cumsum([0, *map(len, keys)], dtype=np.int64),
        np.array(lengths, np.int64),
        np.array([VERDICTS.index(rule[2]) for _, _, rule in keyed], np.uint8),
    ]
    return _MAGIC + b"".join(p.tobytes() for p in parts) + b"".join(keys)


class DigestIndex:
    """A digest file mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is not a digest file")
        n, n_lengths, n_bytes, _ = (int(x) for x in raw[8:40].view(np.int64))
        at = 40
        self.digests = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.lengths = raw[at : at + 8 * n_lengths].view(np.int64).tolist()
        at += 8 * n_lengths
        self.verdicts = raw[at : at + n]
        self.keys = raw[at + n : at + n + n_bytes]

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, or -1; places with the same digest are all compared."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        low = np.searchsorted(self.digests, digests, "left")
        high = np.searchsorted(self.digests, digests, "right")
        for i in np.flatnonzero(low < high):
            for at in range(low[i], high[i]):
                if self.keys[self.offsets[at] : self.offsets[at + 1]].tobytes() == keys[i]:
                    out[i] = at
        return out

    def judge(self, urls: list[str | None]):
        """(hosts, paths, rules, verdicts) per url; the longest rule that fits wins, of equally long ones the longer host."""
        hosts, paths, keys, owner = [], [], [], []
        for u, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            labels = host.split(".") if host else []
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for n in self.lengths:
                    if n <= len(path):
                        keys.append(f"{suffix}\0{path[:n]}".encode())
                        owner.append(u)
        best: list = [None] * len(urls)
        places = self.lookup(keys)
        for i in np.flatnonzero(places >= 0):
            host, _, path = keys[i].decode().partition("\0")
            rank = (len(host) + len(path), len(host), host + path, int(self.verdicts[places[i]]))
            if best[owner[i]] is None or rank > best[owner[i]]:
                best[owner[i]] = rank
        return hosts, paths, [b and b[2] for b in best], [b and VERDICTS[b[3]] for b in best]


def publish(spark: SparkSession, data: bytes) -> str:
    """Writes data to the shared folder and has every executor fetch it; returns the name for SparkFiles."""
    if len(data) > MAX_INDEX_BYTES:
        raise ValueError(f"the digest file has {len(data)} bytes; at most {MAX_INDEX_BYTES} go to every executor")
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row of pages (page_id, url).

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's path.
    Without a fitting rule, rule is null and the verdict is `default`. A null url or one without :// has an empty host
    and path, which no rule fits. Repeated rows are judged each; extra columns are ignored; no rules or no pages are
    allowed.
    """
    name = publish(pages.sparkSession, index_bytes(rules))

    def run(batches):
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, found, verdicts = index.judge(batch.column("url").to_pylist())
            new = [pa.array(x, pa.string()) for x in (hosts, paths, found, [v or default for v in verdicts])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], ["page_id", "url", "host", "path", "rule", "verdict"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string")


def allowed(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """The page_ids that pass."""
    return filtered(pages, rules, default).where(F.col("verdict") == "allow").select("page_id")

"""What the operators share: written stages, raw text buffers, vectorised words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time.
PIECE = 1 << 19


# ---- stages in the shared folder -------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    gone_at_exit(spark, path)
    return out


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete path when it ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop_written(*frames: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in frames:
        drop_path(df.sparkSession, df._tessera_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM collect what nothing holds any more, upon which Spark deletes the shuffle files of finished
    jobs; else they stay on the executors' disks until the driver's memory is scarce."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and what else is asked for, whatever other columns there are; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# ---- text buffers -----------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE):
    """Row ranges (i, j) of about limit bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


# ---- vectorised words -------------------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for key, base in (("up", _M), ("down", _M_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class WordRule:
    """Which bytes belong to a word, and the code that each byte adds to a word's hash."""

    def __init__(self, delimiters, lower: bool):
        self.word = np.ones(256, bool)
        self.word[list(delimiters)] = False
        self.code = _byte_codes()
        if lower:
            self.code[ord("A") : ord("Z") + 1] = self.code[ord("a") : ord("z") + 1]
        self.code[~self.word] = 0

    def words(self, data: np.ndarray, offs: np.ndarray):
        """(hashes, starts, ends, word offsets per row) of all words; equal words have equal hashes."""
        n = len(data)
        if n <= 4 * PIECE:
            hashes, starts, ends = self._words(data, offs)
        else:  # one very long text: cut between words
            parts, at = [], 0
            while at < n:
                to = min(n, at + PIECE)
                while to < n:
                    gap = np.flatnonzero(~self.word[data[to : to + PIECE]])
                    to = to + int(gap[0]) if len(gap) else min(n, to + PIECE)
                    if len(gap):
                        break
                inner = offs[(offs >= at) & (offs <= to)] - at
                h, s, e = self._words(data[at:to], inner)
                parts.append((h, s + at, e + at))
                at = to
            hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
        return hashes, starts, ends, np.searchsorted(starts, offs)

    def _words(self, data, offs):
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        is_word = self.word[data]
        start, end = is_word.copy(), is_word.copy()
        start[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        cut = offs[(offs > 0) & (offs < n)]
        start[cut] = is_word[cut]
        end[cut - 1] = is_word[cut - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        up, down = _powers(n)
        hashes = np.add.reduceat(self.code[data] * up[:n], starts)
        hashes *= down[starts]
        return mix(hashes), starts, ends


#: [^\x20\x09-\x0D]+
SPACED = (0x20, *range(0x09, 0x0E))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_GAPS = tuple(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, at the place of the first."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + words[j : j + n]) * np.uint64(0xA0761D6478BD642F + 2 * j)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

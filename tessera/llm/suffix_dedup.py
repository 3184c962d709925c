"""Exact substring dedup by prefix doubling over sampled suffixes.

Every byte that lies in a string of `length` bytes which also starts earlier in the corpus is to be removed. Rows for
all suffixes of a corpus would take many times its size, so the sort starts from a locally consistent sample: of each
window of `length` bytes, the leftmost position whose 32-byte prefix has the least hash. Equal windows sample the same
place, so each window is judged with the positions that share its sampled prefix.

1. Positions are sorted by their first rank, that of the 32-byte prefix, and by the name of the whole text that the
   position's windows span. A position whose prefix is unique is done. One whose pair is not the first of its kind is
   covered. The first ones of several kinds go on, each with the text that its windows span.
2. Prefix doubling: positions are sorted by the pair of their rank and of the bytes that follow at an offset, which are
   as many as the rank stands for, and get the pair as their new rank: offsets of 32, 64 and so on until the rank
   stands for `length` bytes, or no position is left. A position whose pair is unique loses the windows that reach as
   far as its new rank, as none of them can be found elsewhere. The same is done with what precedes a position.
3. The windows that are left are sorted by the rank pair of their first half and of the half that follows, at an offset
   of length / 2. All but the first of each pair are covered.

A rank is a 64-bit hash of the bytes that it stands for, cut to 32 bits as the second of a pair, so that ranks need no
renumbering between machines. Each task sorts its own positions first and sends one of a kind, so a passage that many
documents share reaches any task a few times only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, drop_written, free_shuffles, mix, pieces, signed, text_bytes, written

_PREFIX = 32
_PLACE = np.uint64((1 << 20) - 1)
_LOW = (1 << 32) - 1
#: A pair's second name keeps 32 bits, which makes 96 with the first.
_SHORT = np.uint64(0xFFFFFFFF00000000)
#: Positions that a task sorts at a time before it sends them.
_CHUNK = 1 << 20
_ROW = "n1 long, n2 long, doc_id long, lo long, hi long, kind int"
_FIELDS = ["n1", "n2", "doc_id", "lo", "hi", "kind"]
#: A position that goes on: where the text that its windows span starts, that text, the first and last windows that are
#: left, its rank by the context on one side, the name of the bytes that come next there, and where it is dealt, see _dealt_rows.
_OPEN_ROW = "doc_id long, start long, lo long, hi long, at long, span binary, rank long, next long, deal long, kind int"
_SAMPLED, _COVERED, _OPEN = 0, 1, 2
_ALONE, _SEVERAL, _MARK = 0, 1, 2


class Names:
    """Names of substrings of a piece of text: hash of data[a:b] for any a, b."""

    def __init__(self, data: np.ndarray):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        self.down = _powers(len(data) + 1)[1]  # has a place for the end of the data
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _powers(len(data) + 1)[0][: len(data)], out=self.total[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a])


def sampled(data: np.ndarray, offs: np.ndarray, length: int):
    """(first window, last window, n1, n2) of all sampled positions of a piece of less than 2**20 bytes; the low bits
    of n2 are the position behind its first window."""
    n, width = len(data), length - _PREFIX + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    names = Names(data)
    m = n - _PREFIX + 1
    prefix = mix((names.total[_PREFIX:] - names.total[:m]) * names.down[:m])
    least = (prefix & ~_PLACE) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: m - width + 1], least[width - span : m - span + 1])
    windows = np.ones(n - length + 1, bool)
    for cut in offs[1:-1]:
        windows[max(0, cut - length + 1) : cut] = False
    starts = np.flatnonzero(windows)
    if not len(starts):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    at = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo, hi, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    shape = (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return lo, hi, prefix[at], (mix(names(lo, hi + length) + shape) & _SHORT) | (at - lo).astype(np.uint64)


def _segments(data: np.ndarray, offs: np.ndarray, length: int):
    """(rows, bytes, offsets, shift) of pieces of less than 2**20 bytes; a longer text comes in overlapping parts."""
    step = 1 << 19
    for i, j in pieces(offs):
        lo, hi = int(offs[i]), int(offs[j])
        if hi - lo < 1 << 20:
            yield np.arange(i, j), data[lo:hi], offs[i : j + 1] - lo, 0
        else:
            for at in range(0, hi - lo - length + 1, step):
                part = data[lo + at : min(hi, lo + at + step + length - 1)]
                yield np.array([i]), part, np.array([0, len(part)]), at


def _batch(n1, n2, doc, lo, hi, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(n1)), pa.array(signed(n2)), pa.array(doc), pa.array(lo), pa.array(hi), pa.array(np.broadcast_to(np.int32(kind), len(doc)).copy())], _FIELDS)


def _merged(doc, lo, hi):
    """Maximal runs of [lo, hi) within each document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((hi, lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    _, row = np.unique(doc, return_inverse=True)
    # ends run on within a document only
    reach = np.maximum.accumulate(hi + row * (int(hi.max()) + 1)) - row * (int(hi.max()) + 1)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1]))))
    return doc[new], lo[new], reach[np.append(new[1:], len(doc)) - 1]


def _sent(n1, n2, doc, lo, hi, length):
    """What a task sends of its positions: the first of each pair; what the others cover, merged."""
    order = np.lexsort((lo, doc, n2, n1))
    n1, n2, doc, lo, hi = (x[order] for x in (n1, n2, doc, lo, hi))
    again = np.zeros(len(n1), bool)
    again[1:] = (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1])
    yield _batch(*(x[~again] for x in (n1, n2, doc, lo, hi)), _SAMPLED)
    if again.any():
        doc, lo, hi = _merged(doc[again], lo[again], hi[again] + length)
        yield _batch(mix(doc.astype(np.uint64)), np.zeros(len(doc), np.uint64), doc, lo, hi, _COVERED)


def _collected(rows, length):
    """Sends rows (n1, n2, doc, lo, hi arrays) chunk by chunk."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= _CHUNK:
            yield from _sent(*(np.concatenate(x) for x in zip(*held)), length)
            held, size = [], 0
    if size:
        yield from _sent(*(np.concatenate(x) for x in zip(*held)), length)


def _judged(batches, length, open_too: bool):
    """Rows sorted by (n1, n2, doc_id, lo): those that aren't the first of their pair are covered, as [lo, hi + length);
    with open_too the first ones of an n1 with several n2 are open. Keeps one row from batch to batch."""
    last = None  # (n1, n2, doc, lo) of the current pair's first
    waiting = None  # the current n1's first row, while it has one n2
    for batch in batches:
        n1, n2, doc, lo, hi, kind = (batch.column(c).to_numpy() for c in _FIELDS)
        done = kind == _COVERED
        if done.any():
            yield _batch(n1[done], n2[done], doc[done], lo[done], hi[done], _COVERED)
            n1, n2, doc, lo, hi = (x[~done] for x in (n1, n2, doc, lo, hi))
        if not len(n1):
            continue
        if last is None:
            last = (~n1[0], 0, 0, 0)
        new1 = n1 != np.concatenate(([last[0]], n1[:-1]))
        new2 = new1 | (n2 != np.concatenate(([last[1]], n2[:-1])))
        first = np.maximum.accumulate(np.where(new2, np.arange(len(n1)), -1))
        first_doc, first_lo = np.where(first < 0, last[2], doc[first]), np.where(first < 0, last[3], lo[first])
        covered = ~new2 & ((doc != first_doc) | (lo != first_lo))
        d, a, b = _merged(doc[covered], lo[covered], hi[covered] + length)
        if len(d):
            yield _batch(mix(d.astype(np.uint64)), np.zeros(len(d), np.uint64), d, a, b, _COVERED)
        heads = np.flatnonzero(new2)
        if open_too and len(heads):
            later = ~new1[heads]
            is_open = later.copy()
            is_open[:-1] |= later[1:]
            if waiting is not None and later[0]:
                yield _batch(*waiting, _OPEN)
            if is_open.any():
                o = heads[is_open]
                yield _batch(n1[o], n2[o], doc[o], lo[o], hi[o], _OPEN)
            tail = slice(heads[-1], heads[-1] + 1)
            waiting = None if is_open[-1] else tuple(x[tail].copy() for x in (n1, n2, doc, lo, hi))
        last = (n1[-1], n2[-1], first_doc[-1], first_lo[-1])


class Contexts:
    """The spans of a batch of open positions, and names of the bytes around each position."""

    def __init__(self, table: pa.RecordBatch, length: int):
        self.length, self.table = length, table
        self.start, self.lo, self.hi, self.at, self.rank, self.next = (table.column(c).to_numpy() for c in ("start", "lo", "hi", "at", "rank", "next"))
        data, offs = text_bytes(table.column("span"))
        self.first, self.after = offs[:-1], offs[1:]
        self.names = Names(data)
        self.place = self.first + self.at - self.start

    def prefix(self) -> np.ndarray:
        return signed(self.names(self.place, self.place + _PREFIX))

    def beyond(self, side: int, known: int, reach: int) -> np.ndarray:
        """Names of the bytes by which a rank of known bytes grows to reach bytes, after the position (side 1) or before
        it (side -1); at the span's ends fewer."""
        if side > 0:
            a, b = self.place + known, self.place + reach
        else:
            a, b = self.place + _PREFIX - reach, self.place + _PREFIX - known
        a, b = (np.clip(x, self.first, self.after) for x in (a, b))
        return signed(self.names(a, b))

    def shrunk(self, side: int, reach: int, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) without the windows that hold the reach bytes of a unique rank."""
        if side > 0:
            return self.lo, np.where(unique, np.minimum(self.hi, self.at - self.length + reach - 1), self.hi)
        return np.where(unique, np.maximum(self.lo, self.at - (reach - _PREFIX) + 1), self.lo), self.hi

    def rows(self, keep, lo, hi, rank, following) -> pa.RecordBatch:
        t = self.table
        out = [t.column("doc_id"), t.column("start"), pa.array(lo), pa.array(hi), t.column("at"), t.column("span"), pa.array(rank), pa.array(following)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "lo", "hi", "at", "span", "rank", "next"]).filter(pa.array(keep))

    def windows(self):
        """(n1, n2, doc_id, start) of all windows that are left: the names of their halves."""
        counts = self.hi - self.lo + 1
        row = np.repeat(np.arange(len(counts)), counts)
        p = self.lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        a, half = self.first[row] + p - self.start[row], self.length // 2
        return self.names(a, a + half), self.names(a + half, a + self.length) & _SHORT, self.table.column("doc_id").to_numpy()[row], p


def _with_repeats(batches):
    """(table, whether each row's (rank, next) is that of another row) of sorted batches; the last row of each batch
    waits for the next one."""
    held, was = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        rank, following = (t.column(c).to_numpy() for c in ("rank", "next"))
        same = (rank[1:] == rank[:-1]) & (following[1:] == following[:-1])
        repeated = np.concatenate((same, [False])) | np.concatenate(([was], same))
        was = bool(repeated[-1])
        held = t.slice(t.num_rows - 1)
        if t.num_rows > 1:
            yield t.slice(0, t.num_rows - 1), repeated[:-1]
    if held is not None:
        yield held, np.array([was])


def _dealt_rows(batch: pa.RecordBatch):
    """Open positions with where to deal them: a position that is alone with its rank pair in the batch goes to its pair,
    as does a mark for each pair that several have; these go anywhere, as they are known to repeat. So a pair that very
    many positions have meets in one place a few times only."""
    if not batch.num_rows:
        return
    rank, following = (batch.column(c).to_numpy() for c in ("rank", "next"))
    order = np.lexsort((following, rank))
    same = (rank[order][1:] == rank[order][:-1]) & (following[order][1:] == following[order][:-1])
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    several = np.zeros(len(rank), bool)
    several[order] = again
    pair = signed(mix(rank.view(np.uint64) + following.view(np.uint64)))
    own = signed(mix(batch.column("doc_id").to_numpy().view(np.uint64) ^ mix(batch.column("at").to_numpy().astype(np.uint64))))
    deal, kind = np.where(several, own, pair), np.where(several, _SEVERAL, _ALONE).astype(np.int32)
    names = [*batch.schema.names, "deal", "kind"]
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal), pa.array(kind)], names)
    marked = order[again & ~np.concatenate(([False], same))]
    if len(marked):
        t = batch.take(pa.array(marked))
        spans = pa.array([b""] * len(marked), pa.binary())
        yield pa.RecordBatch.from_arrays([spans if n == "span" else t.column(n) for n in t.schema.names] + [pa.array(pair[marked]), pa.array(np.full(len(marked), _MARK, np.int32))], names)


def doubled(positions: DataFrame, length: int, parts: int) -> DataFrame:
    """positions (_OPEN_ROW, with their first ranks) without the windows that prefix doubling finds to be unique."""
    for side in (1, -1):
        known = _PREFIX
        while known < length:
            reach = min(2 * known, length)
            after = min(2 * reach, length)

            def rerank(batches, side=side, known=known, reach=reach, after=after):
                for table, repeated in _with_repeats(batches):
                    kind = table.column("kind").to_numpy()
                    unique = (~repeated & (kind == _ALONE))[kind != _MARK]
                    c = Contexts(table.filter(pa.array(kind != _MARK)), length)
                    lo, hi = c.shrunk(side, reach, unique)
                    if reach < length:
                        rank, following = signed(mix(c.rank.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.next.view(np.uint64))), c.beyond(side, reach, after)
                    else:  # the other side starts anew
                        rank, following = c.prefix(), c.beyond(-1, _PREFIX, min(2 * _PREFIX, length))
                    yield from _dealt_rows(c.rows(lo <= hi, lo, hi, rank, following))

            before = positions
            positions = written(_dealt(positions, "deal", parts).sortWithinPartitions("rank", "next").mapInArrow(rerank, _OPEN_ROW), f"offset-{known}")
            drop_written(before)
            free_shuffles(positions.sparkSession)
            if positions.isEmpty():
                return positions
            known = reach
    return positions


def _dealt(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """rows dealt by a column to parts, or to the session's number where that is enough."""
    enough = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= parts
    return rows.repartition(by) if enough else rows.repartition(parts, by)


def _parts(docs: DataFrame) -> int:
    """Partitions for the positions of docs: some 64 MB each, by the plan's estimate of the input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan without an estimate says 2**63 - 1 or a product of it
    return 1 if size >= 1 << 60 else max(1, min(100_000, -(-3 * size // (64 << 20))))


def _sorted_by_pair(rows: DataFrame, parts: int) -> DataFrame:
    return _dealt(rows, "n1", parts).sortWithinPartitions("n1", "n2", "doc_id", "lo")


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, one row for each doc_id."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def touched_documents(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): doc_id and text of documents with something covered; (doc_id, lo, hi) of what is, unmerged.
    Both are written. rows: what _documents returns."""
    spark, parts = rows.sparkSession, _parts(rows)

    def sample(batches):
        def found():
            for batch in batches:
                data, offs = text_bytes(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                for members, part, inner, shift in _segments(data, offs, length):
                    lo, hi, n1, n2 = sampled(part, inner, length)
                    row = np.searchsorted(inner, lo, "right") - 1
                    base = inner[row]
                    yield n1, n2, ids[members[row]], lo - base + shift, hi - base + shift

        yield from _collected(found(), length)

    def settle(batches):
        return _judged(batches, length, open_too=True)

    def finish(batches):
        return _judged(batches, length, open_too=False)

    judged = _sorted_by_pair(rows.mapInArrow(sample, _ROW), parts).mapInArrow(settle, _ROW)
    first = written(judged.select("doc_id", "lo", "hi", F.col("n2").bitwiseAND(_LOW).alias("behind"), "kind"), "offset-0")
    free_shuffles(spark)
    by_doc = first.groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == _OPEN, F.struct("lo", "hi", "behind"))).alias("open"))
    texts = written(rows.join(by_doc.hint("merge"), "doc_id"), "texts")
    free_shuffles(spark)

    def contexts(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            lists = batch.column("open")
            ends = lists.offsets.to_numpy()
            inner = lists.values.slice(ends[0], ends[-1] - ends[0]).flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(ends))
            lo, hi, behind = (x.to_numpy() for x in inner)
            for at in range(0, len(doc), 10_000):
                d, a, b, c = (x[at : at + 10_000] for x in (doc, lo, hi, behind))
                size = b + length - a
                edge = np.concatenate(([0], np.cumsum(size)))
                body = data[np.arange(edge[-1]) + np.repeat(offs[d] + a - edge[:-1], size)]
                spans = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(body)])
                none = pa.array(np.zeros(len(d), np.int64))
                ids = batch.column("doc_id").take(pa.array(d))
                c = Contexts(pa.RecordBatch.from_arrays([ids, pa.array(a), pa.array(a), pa.array(b), pa.array(a + c), spans, none, none], ["doc_id", "start", "lo", "hi", "at", "span", "rank", "next"]), length)
                yield from _dealt_rows(c.rows(np.ones(len(d), bool), a, b, c.prefix(), c.beyond(1, _PREFIX, min(2 * _PREFIX, length))))

    def windows(batches):
        def found():
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    n1, n2, doc, p = Contexts(batch.slice(at, 2000), length).windows()
                    yield n1, n2, doc, p, p

        yield from _collected(found(), length)

    positions = written(texts.where(F.size("open") > 0).select("doc_id", "text", "open").mapInArrow(contexts, _OPEN_ROW), "positions")
    left = doubled(positions, length, parts)
    second = _sorted_by_pair(left.where(F.col("kind") != _MARK).mapInArrow(windows, _ROW), parts).mapInArrow(finish, _ROW)
    spans = written(first.where(F.col("kind") == _COVERED).select("doc_id", "lo", "hi").unionByName(second.select("doc_id", "lo", "hi")), "spans")
    free_shuffles(spark)
    drop_written(first, left)
    return texts.select("doc_id", "text"), spans


def _cut(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, spans (first, after), kept_sha256 and, with_text, kept, of the documents that lose bytes."""
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))

    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            ids, rows = batch.column("doc_id"), []
            for d, found in enumerate(batch.column("found").to_pylist()):
                lo, hi = (np.array([f[n] for f in found], np.int64) for n in ("lo", "hi"))
                _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                part = data[offs[d] : offs[d + 1]]
                keep = b"".join(part[a:b].tobytes() for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(part)]))
                rows.append({"doc_id": ids[d].as_py(), "spans": [{"first": a, "after": b} for a, b in zip(lo.tolist(), hi.tolist())], "kept_sha256": hashlib.sha256(keep).hexdigest(), "kept": keep if with_text else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return texts.join(lists.hint("merge"), "doc_id").mapInArrow(run, "doc_id long, spans array<struct<first:long,after:long>>, kept_sha256 string, kept binary")


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept_sha256 of every document of docs (doc_id, text).

    Texts are judged as UTF-8 bytes; a byte goes that is covered by a string of `length` bytes (64 or more) which also
    starts earlier: in a document of smaller doc_id, or before in the same one. Strings never cross documents and are
    judged on the input. spans are the maximal removed runs (first byte, byte after); kept_sha256 is of the bytes left.
    Null and empty texts have no bytes, texts shorter than length lose none. Rows that repeat a doc_id are one document
    with the least of their texts; rows without doc_id are left out; extra columns are ignored; an empty table gives
    no rows.
    """
    rows = _documents(docs)
    plain = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    cut = _cut(*touched_documents(rows, length), with_text=False)
    out = plain.join(cut.select("doc_id", "spans", "kept_sha256"), "doc_id", "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])
    return out.select(
        "doc_id", "n_bytes", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.when(F.col("spans").isNotNull(), F.size("spans")), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("spans", F.array().cast("array<struct<first:long,after:long>>")).alias("spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id and kept, the bytes that are left, of every document; see repeats()."""
    rows = _documents(docs)
    cut = _cut(*touched_documents(rows, length), with_text=True).select("doc_id", "kept")
    return rows.join(cut, "doc_id", "left").select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))

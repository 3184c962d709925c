"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set holds the hashes of its distinct word shingles. Its sketch has `rows * bands` coordinates. In round r
every shingle is thrown into one bin with a hashed value; a bin keeps the least value of the first round that reaches
it. Later rounds aim at one bin each, so that after at most twice as many rounds as bins every coordinate is filled.
Two documents agree in a coordinate with a chance equal to their Jaccard similarity, and since a round samples without
replacement the estimate is at least as concentrated as with independent minima.

Documents with equal sets are one class from the start. Classes that share a band meet in a bucket; the buckets with
the same least member, its hub, make one family, so that a class is in as many families as it has hubs, and any two
classes that share a bucket share a family. First each member is verified against its hub on full sets, in blocks that
a family of any size is dealt to, so that every text is sent once for each of its families. Buckets whose members are
then of one component are done. The members of the others meet in pairs of blocks, where only those of different
components are compared. Only links that connect something are returned: no link between components is lost, and no
group is expanded into pairs. Blocks are bounded by the number of their members and of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, WordRule, drop_written, id_text, mix, pieces, shingle_hashes, signed, text_bytes, written
from .graph import components

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; fewer than k words are one shingle; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return shingle_hashes(words, len(words))
    return np.unique(shingle_hashes(words, k))


class Sketcher:
    """Fast similarity sketches of t coordinates."""

    def __init__(self, t: int, seed: int = 1):
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def __call__(self, items: np.ndarray) -> np.ndarray:
        t, out, r = np.uint64(self.t), np.full(self.t, _EMPTY), 0
        while r < self.t:
            # several rounds at a time; the first round and the least value of a bin are written last
            to = min(self.t, r + max(2, 2048 // len(items)))
            values = mix(items[None, :] ^ self.seeds[r:to, None])
            values.sort(axis=1)
            values = values.ravel()[::-1]
            bins = ((values >> np.uint64(32)) * t) >> np.uint64(32)
            filled = np.full(self.t, _EMPTY)
            filled[bins.astype(np.int64)] = values
            out = np.where(out == _EMPTY, filled, out)
            r = to
            if not (out == _EMPTY).any():
                return out
        for b in np.flatnonzero(out == _EMPTY):
            out[b] = mix(items ^ self.seeds[self.t + b]).min()
        return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    rows = sketch.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = mix((out + rows[:, j]) * np.uint64(0xA0761D6478BD642F))
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, k: int, bands: int, rows: int, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (s1, s2) and the sketch's band hashes."""

    def run(batches):
        rule, sketcher = WordRule(SPACED, lower), Sketcher(bands * rows)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in pieces(offs):
                lo = offs[i]
                hashes, _, _, at = rule.words(data[lo : offs[j]], offs[i : j + 1] - lo)
                n, s1, s2 = (np.zeros(j - i, np.int64) for _ in range(3))
                all_bands = []
                for d in range(j - i):
                    items = shingle_set(hashes[at[d] : at[d + 1]], k)
                    if len(items):
                        n[d], s1[d], s2[d] = len(items), signed(mix(items).sum(keepdims=True))[0], signed(mix(items ^ _EMPTY).sum(keepdims=True))[0]
                        all_bands.append(signed(band_hashes(sketcher(items), bands)))
                    else:
                        all_bands.append(np.zeros(0, np.int64))
                counts = np.cumsum([0, *map(len, all_bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(counts), pa.array(np.concatenate(all_bands)))
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n), pa.array(s1), pa.array(s2), lists], schema=_SIGNED)

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


class Family:
    """Full sets of some documents, compared by 100 * intersection >= percent * union.

    A set's parity bitmap has a bit for each bin that holds an odd number of its items. Two bitmaps differ in at most
    as many bits as the sets have items that they do not share, so a pair that differs in more bits than the threshold
    allows is ruled out for certain; what is left is intersected."""

    BINS = 2048

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(x) for x in sets])
        bits = np.zeros((len(sets), self.BINS), np.uint8)
        for row, items in zip(bits, sets):
            row[:] = np.bincount((items >> np.uint64(32)).astype(np.int64) % self.BINS, minlength=self.BINS) & 1
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def possible(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ys that may be linked with x, the likeliest first."""
        differ = np.bitwise_count(self.bits[ys] ^ self.bits[x]).sum(axis=1)
        total = self.size[ys] + self.size[x]
        # shared >= percent * union / 100 means that at most this many items are not shared
        most = total - 2 * np.ceil(self.percent * total / (100 + self.percent)).astype(np.int64)
        may = (np.maximum(differ, np.abs(self.size[ys] - self.size[x])) <= most) & (self.size[ys] > 0)
        return ys[may][np.argsort(differ[may], kind="stable")]

    def linked(self, x: int, y: int) -> bool:
        shared = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        return shared > 0 and 100 * shared >= self.percent * (self.size[x] + self.size[y] - shared)

    def links(self, x: int, ys: np.ndarray):
        """Joins x with those of ys that it is linked with and not connected with yet; yields the new links."""
        for y in self.possible(x, ys):
            if self.root(x) != self.root(y) and self.linked(x, y):
                self.parent[self.root(x)] = self.root(y)
                yield x, int(y)


#: What a block of a family holds at most: members, and shingles of them all together.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 17


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (hub, member, size, ...) with blocks and block, by the hash of the member; (hub, blocks) of all hubs.

    Only families of several blocks are joined back, from a written table, so that the rows of a large one can be split."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = written(rows.groupBy("hub").agg(blocks.alias("blocks")), "sizes")
    dealt = rows.join(sizes.where("blocks > 1"), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")), sizes


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.hint("merge").join(id_text(docs).select(F.col("doc_id").alias("member"), "text"), "member")


def _sets(group: pa.Table, order: np.ndarray, k: int, lower: bool) -> list[np.ndarray]:
    rule = WordRule(SPACED, lower)
    data, offs = text_bytes(group.column("text"))
    out = []
    for d in order:
        part = data[offs[d] : offs[d + 1]]
        out.append(shingle_set(rule.words(part, np.array([0, len(part)]))[0], k))
    return out


def _link_table(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    a, b = (np.array([ids[f[n]] for f in found], np.int64) for n in (0, 1))
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def hub_links(pairs: DataFrame, docs: DataFrame, k: int, percent: int, lower: bool = True) -> DataFrame:
    """Links (a, b) of members with their hubs; pairs (member, hub, size). One row and one text for each pair."""
    rows, sizes = _in_blocks(pairs)
    hubs = sizes.select("hub", F.col("hub").alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.select("hub", "member", "block")

    def run(key, group):
        ids = group.column("member").to_numpy()
        order = np.argsort(np.where(ids == key[0].as_py(), np.iinfo(np.int64).min, ids), kind="stable")
        family = Family(_sets(group, order, k, lower), percent)
        return _link_table(ids[order], list(family.links(0, np.arange(1, len(ids)))) if len(ids) > 1 else [])

    return _with_text(rows.unionByName(hubs), docs).groupBy("hub", "block").applyInArrow(run, "a long, b long")


def block_links(rows: DataFrame, docs: DataFrame, k: int, percent: int, lower: bool = True) -> DataFrame:
    """Links (a, b) that connect what is linked between different components of each family; rows (hub, member,
    component, of_hub, size), of_hub being the component of the hub.

    Members that are not of their hub's component meet all members of the family, block by block; those that are have
    nothing to meet among themselves."""
    apart = rows.where("component <> of_hub").select("hub", "member", "component", "size")
    rows = rows.join(apart.select("hub").distinct(), "hub", "left_semi").select("hub", "member", "component", "size")
    (left, lefts), (right, rights) = _in_blocks(apart), _in_blocks(rows)
    all_of = lambda sizes, name: sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name))
    columns = ["hub", "member", "component", "i", "j", "side"]
    dealt = left.withColumnRenamed("block", "i").join(all_of(rights, "j"), "hub").withColumn("side", F.lit(0)).select(*columns)
    dealt = dealt.unionByName(right.withColumnRenamed("block", "j").join(all_of(lefts, "i"), "hub").withColumn("side", F.lit(1)).select(*columns))

    def run(key, group):
        ids, side, parts = (group.column(c).to_numpy() for c in ("member", "side", "component"))
        order = np.lexsort((ids, side))
        ids, side, parts = ids[order], side[order], parts[order]
        found: list[tuple[int, int]] = []
        if len(ids) and (parts != parts[0]).any():
            family = Family(_sets(group, order, k, lower), percent)
            # members of one component are connected from the start
            _, first, same = np.unique(parts, return_index=True, return_inverse=True)
            family.parent = first[same].tolist()
            others = np.flatnonzero(side == 1)
            for x in np.flatnonzero(side == 0):
                found += family.links(int(x), others[parts[others] != parts[x]])
        return _link_table(ids, found)

    return _with_text(dealt, docs).groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked whose sets of k-word shingles have 100 * intersection >= percent * union; component_id is the
    least doc_id that can be reached. Words are runs of characters other than ASCII white space; A-Z are lower-cased.
    A null, empty or blank text has an empty set and links with nothing. Rows that repeat a doc_id are returned each;
    they are one document whose texts are all looked at. Rows without doc_id are kept unless they are copies of a row
    that has one. Extra columns are ignored. An empty table gives no rows.
    A link at the threshold is missed with a chance of (1 - (percent / 100) ** rows) ** bands, below 1e-6.
    """
    sigs = written(signatures(docs, k, bands, rows), "signatures")
    full = sigs.where("n_shingles > 0")
    classes = written(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi")
    rep_rows = reps.select(F.col("doc_id").alias("member"), F.col("n_shingles").alias("size"), F.explode("bands").alias("h"))
    shared = rep_rows.groupBy("h").agg(F.min("member").alias("hub"), F.count("*").alias("n")).where("n > 1").select("h", "hub")
    buckets = written(rep_rows.join(shared, "h"), "buckets")
    links = written(hub_links(buckets.where("member <> hub").select("member", "hub", "size").distinct(), docs, k, percent), "links")
    found = written(components(links), "components")
    # buckets whose members are not all of one component
    of = buckets.join(found.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    apart = of.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    left = of.join(apart, "h", "left_semi").select("hub", "member", "component", "size").distinct()
    left = left.join(found.select(F.col("node").alias("hub"), F.col("component").alias("of_hub")), "hub", "left")
    left = written(left.withColumn("of_hub", F.coalesce("of_hub", "hub")), "apart")
    if not left.isEmpty():
        more = written(block_links(left, docs, k, percent), "links")
        if not more.isEmpty():
            found = written(components(links.unionByName(more)), "components")
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep").select("s1", "s2", "n_shingles", "component")
    copies = classes.join(found.select(F.col("node").alias("rep")), "rep", "left_anti").select("s1", "s2", "n_shingles", F.col("rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "s1", "s2").join(named.unionByName(copies), ["s1", "s2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    drop_written(buckets, left)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

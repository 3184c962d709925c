"""Exact search over all pairs of two sets of vectors, in memory that does not grow with either.

One side is written once to the shared folder, packed, and read pack by pack by every task; the other is dealt into blocks,
each of which one task holds. So what is shuffled and written is in proportion to the two sides, and only reads and products
grow with the pairs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from tessera.operators.order import shared_dir

#: Rows that a task holds, rows that it reads at a time, and rows of its own that meet those at a time.
BLOCK_ROWS, PACK_ROWS, STRIP_ROWS = 16384, 4096, 1024
#: Pairs whose exact products are made at a time.
EXACT_PAIRS = 65536


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles of an Arrow column of lists of one length, without Python objects."""
    lists = vectors.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def packs(rows: DataFrame, numbers: tuple[str, ...] = (), each: str | None = None, pack_rows: int = PACK_ROWS) -> Callable[[], Iterator[tuple]]:
    """A function that reads rows (id, v, numbers ..., each) again in a task, as (each, ids, matrix, numbers ...) of
    about pack_rows rows or fewer that have one value of each. Rows without a vector are left out."""
    names = ["id", *numbers]
    schema = pa.schema([("each", pa.string()), ("rows_", pa.int64()), ("v", pa.binary())] + [(c, pa.binary()) for c in names])

    def pack(batches):
        held: dict = {}

        def row(value, parts):
            cols = {c: [np.concatenate([p[c] for p in parts]).tobytes()] for c in ["v", *names]}
            return pa.RecordBatch.from_pydict(cols | {"each": [value], "rows_": [size(parts)]}, schema=schema)

        def size(parts):
            return sum(len(p["id"]) for p in parts)

        for batch in batches:
            table = pa.table(batch)
            for value in table["each"].unique().to_pylist() if each else [None] * bool(len(table)):
                part = table
                if each:
                    part = table.filter(pc.is_null(table["each"]) if value is None else pc.fill_null(pc.equal(table["each"], value), False))
                cols = {"v": matrix(part["v"])} | {c: part[c].to_numpy() for c in names}
                for at in range(0, len(part), pack_rows):
                    new = {c: x[at : at + pack_rows] for c, x in cols.items()}
                    if value in held and size(held[value]) + len(new["id"]) > pack_rows:
                        yield row(value, held.pop(value))
                    held.setdefault(value, []).append(new)
            if sum(map(size, held.values())) > 16 * pack_rows:  # many values of few rows each
                yield from (row(*x) for x in held.items())
                held = {}
        yield from (row(*x) for x in held.items())

    cols = [f"cast({c} as bigint) as {c}" for c in names] + ["cast(v as array<double>) as v"] + ([f"cast({each} as string) as each"] if each else [])
    folder = f"{shared_dir(rows.sparkSession)}/packs-{uuid.uuid4().hex}"
    packed = rows.where("v is not null").selectExpr(*cols).mapInArrow(pack, ", ".join(["each string", "rows_ bigint", "v binary"] + [f"{c} binary" for c in names]))
    packed.write.option("compression", "none").parquet(folder)
    fs, path = _fs(folder)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))

    def read() -> Iterator[tuple]:
        fs, _ = _fs(folder)
        held: dict = {}
        for file in files:
            with fs.open_input_file(file) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                    for r in batch.to_pylist():
                        parts = held.setdefault(r["each"], [])
                        parts.append([np.frombuffer(r["id"], np.int64), np.frombuffer(r["v"], np.float64).reshape(r["rows_"], -1), *[np.frombuffer(r[c], np.int64) for c in numbers]])
                        if sum(len(p[0]) for p in parts) * 2 > pack_rows:  # small packs are read together
                            yield r["each"], *[np.concatenate(x) for x in zip(*held.pop(r["each"]))]
                if sum(len(p[0]) for parts in held.values() for p in parts) > 16 * pack_rows:
                    yield from ((value, *[np.concatenate(x) for x in zip(*parts)]) for value, parts in held.items())
                    held = {}
        for value, parts in held.items():
            yield value, *[np.concatenate(x) for x in zip(*parts)]

    return read


def blocks(rows: DataFrame, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """f of each block of at most block_rows rows, dealt by key, each block one task where its rows are many."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // block_rows), min(2 * cores, -(-n // min(block_rows, 256))))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == block_rows:
                    yield from f(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from f(pa.Table.from_batches(held))

    return rows.repartition(parts, key).mapInArrow(run, schema)


def true_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells of a contiguous mask; where they are few, by words of eight cells."""
    flat = mask.reshape(-1)
    if flat.size % 8 == 0 and len(words := np.flatnonzero(flat.view(np.uint64))) * 16 < flat.size:
        at = (words[:, None] * 8 + np.arange(8)).ravel()
        at = at[flat[at]]
    else:
        at = np.flatnonzero(flat)
    return np.divmod(at, mask.shape[1])


def products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x with rows j of y, to 9 digits, so that equal scores tie by id on every machine."""
    return np.concatenate([np.round(np.einsum("ij,ij->i", x[i[at : at + EXACT_PAIRS]], y[j[at : at + EXACT_PAIRS]]), 9) for at in range(0, len(i), EXACT_PAIRS)] or [np.zeros(0)])


def slack(dims: int) -> float:
    """More than a product of single-precision vectors shorter than 1.5 and rounding to 9 digits can be off by."""
    return (dims + 8) * 2.0**-22


class Best:
    """The k best (score, id) of each of n rows, equal scores by the least id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        worst = self.score[at, -1]
        keep = np.isfinite(score) & ((score > worst) | ((score == worst) & (ids < self.id[at, -1])))
        at, ids, score = at[keep], ids[keep], score[keep]
        if not len(at):
            return
        k = self.score.shape[1]
        rows, place = np.unique(at, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        s, i = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((i, -s, group))
        group = group[order]
        keep = order[np.arange(len(group)) - np.searchsorted(group, np.arange(len(rows)))[group] < k]
        self.score[rows], self.id[rows] = s[keep].reshape(-1, k), i[keep].reshape(-1, k)


def best_of(ids: np.ndarray, x: np.ndarray, packs_: Iterator[tuple], k: int, metric: str = "cosine", skip_same: bool = False, floor: float = -np.inf, keys: np.ndarray | None = None) -> dict:
    """{each: Best} of rows (ids, x), with scores of floor or more, over packs_ of (each, ids, matrix, keys ...).

    Cosines, and products of rows that are shorter than 1.5 ("short"), are made in single precision first; only pairs that
    may be among the best by that are made exactly. keys: rows meet only where one of their keys is equal."""
    found: dict = {}
    fast = metric in ("cosine", "short")
    x = units(x) if metric == "cosine" else x
    left = x.astype(np.float32) if fast else x
    for each, others, y, *own in packs_:
        best = found[each] if each in found else found.setdefault(each, Best(len(x), k))
        y = units(y) if metric == "cosine" else y
        right, off = (y.astype(np.float32), slack(x.shape[1])) if fast else (y, 0.0)
        for at in range(0, len(x), STRIP_ROWS):
            rows = slice(at, at + STRIP_ROWS)
            s = left[rows] @ right.T
            if metric == "euclidean":
                s = 1 / (1 + np.sqrt(np.maximum(0, (x[rows] * x[rows]).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * s)))
            s = s if fast else np.where(np.isfinite(s), np.round(s, 9), -np.inf)
            limit = np.maximum(best.score[rows, -1], floor)
            low = (limit - off).astype(s.dtype)
            open_ = np.flatnonzero(limit == -np.inf)
            if len(open_):  # rows of fewer than k so far: of this pack their k best
                few = s[open_]
                few[~np.isfinite(few)] = -np.inf
                if skip_same:
                    few[ids[rows][open_][:, None] == others[None]] = -np.inf
                if keys is not None:
                    few[~np.any([keys[rows][open_, c][:, None] == own[c][None] for c in range(len(own))], axis=0)] = -np.inf
                kth = np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k] if few.shape[1] > k else np.full(len(few), -np.inf)
                low[open_] = np.maximum(kth - 2 * off, np.finfo(s.dtype).min)
                s[open_] = few
            i, j = true_cells(s >= low[:, None])
            keep = np.ones(len(i), bool)
            if skip_same:
                keep &= ids[rows][i] != others[j]
            if keys is not None:
                keep &= np.any([keys[rows][i, c] == own[c][j] for c in range(len(own))], axis=0)
            i, j = i[keep], j[keep]
            score = products(x[rows], y, i, j) if fast else s[i, j]
            keep = score >= floor
            best.add(i[keep] + at, others[j[keep]], score[keep])
    return found

"""Quality classifier by positive-unlabelled learning.

Documents labelled good are the trusted positives, all documents of the training fold are unlabelled. The classifier is
linear in a fixed basis: ratios of the whole text, bounded random functions of them, and the shares of its hashed words
and pairs of words. With the squared loss the positive-unlabelled risk

    prior * E_p[(g - 1)**2] + max(0, E_u[(g + 1)**2] - prior * E_p[(g + 1)**2])

depends on the corpus through the means and second moments of the basis alone. These are summed over all documents in
one distributed pass, so that the risk that is minimised is that of the whole corpus at every size. A first classifier,
of positives against unlabelled, tells the two groups apart; the least ratio of their shares above a threshold of its
score, from counts over all documents in a second pass, estimates the class prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, pieces, shingle_hashes, text_bytes
from .textstats import TextStats

#: Ratios of a text, with what is usual and how much they vary.
RATIOS = {
    "length": (5.5, 1.5), "symbols": (0.0, 0.2), "repeated lines": (0.0, 0.2), "repeated words": (0.0, 0.2), "upper case": (0.03, 0.1),
    "word length": (5.0, 1.5), "bangs": (0.0, 0.2), "marks": (0.1, 0.1), "digits": (0.1, 0.5), "distinct words": (0.6, 0.2),
}
#: Random functions of the ratios; buckets of words, and of pairs of words.
_RANDOM, _BUCKETS = 96, 128
#: Fixed value: how much the buckets weigh against the ratios.
_WORDS = 0.3
#: What a basis has: a constant, the ratios, the random functions, the buckets.
SIZE = 1 + len(RATIOS) + _RANDOM + 2 * _BUCKETS
_BINS, _REACH = 4000, 4.0
#: What holds the weights back: as much as from this many documents, and a little at every size.
_RIDGE_DOCUMENTS, _RIDGE = 3.0, 1e-3


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of RATIOS from TextStats' counts, scaled."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, lines, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    x = np.stack(
        [np.log1p(c["n_words"]), c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / letters,
         c["word_chars"] / words, c["n_bangs"] / words, c["n_marks"] / words, c["n_digits"] / words, c["n_distinct"] / words],
        axis=1,
    )
    usual, spread = np.array(list(RATIOS.values())).T
    return np.clip((x - usual) / spread, -6, 6)


class Basis:
    """The basis of a piece of texts."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.w, self.b = rng.normal(0, 0.6, (len(RATIOS), _RANDOM)), rng.normal(0, 1, _RANDOM)
        self.stats = TextStats()

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        counts, hashes, at = self.stats(data, offs)
        n = len(offs) - 1
        x = ratios(counts)
        row = np.repeat(np.arange(n), np.diff(at))
        # the share of each bucket, as a root, so that common words do not drown the others
        one = np.bincount(row * _BUCKETS + (hashes >> np.uint64(57)).astype(np.int64), minlength=n * _BUCKETS).reshape(n, _BUCKETS)
        pairs = shingle_hashes(hashes, 2)
        inner = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
        two = np.bincount(row[1:][inner] * _BUCKETS + (pairs[inner] >> np.uint64(57)).astype(np.int64), minlength=n * _BUCKETS).reshape(n, _BUCKETS)
        words = np.maximum(np.diff(at), 1)[:, None]
        return np.hstack([np.ones((n, 1)), x, np.tanh(x @ self.w + self.b), _WORDS * np.sqrt(one / words), _WORDS * np.sqrt(two / words)])


def _rows_of(batch: pa.RecordBatch, place, basis: Basis):
    """(i, j, basis rows) of a batch, some rows at a time."""
    data, offs = text_bytes(batch.column(place))
    for i, j in pieces(offs):
        for a in range(i, j, 4096):
            b = min(j, a + 4096)
            yield a, b, basis(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def held_out(doc_id):
    """The rows whose labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# ---- what is summed over the corpus ---------------------------------------------------

#: Roles: all documents; the trusted ones in two halves, the first of which the first classifier is fitted on.
_ALL, _FIRST, _SECOND = 0, 1, 2


def _roles(batch: pa.RecordBatch) -> list[np.ndarray]:
    trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
    even = (mix(batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) & np.uint64(1)) == 0
    return [np.ones(len(even), bool), trusted & even, trusted & ~even]


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """{role: (documents, sums of the products of each two of the basis)} of rows (doc_id, text, trusted). The first of
    the basis is constant, so that a matrix holds the plain sums too.

    Each task sends its sums; these are added in groups of 64 tasks, of such groups and so on, in a fixed order."""
    schema, types = "role int, task long, n long, sums binary", pa.schema([("role", pa.int32()), ("task", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])

    def run(batches):
        basis, n, sums = Basis(), [0] * 3, [np.zeros((SIZE, SIZE)) for _ in range(3)]
        for batch in batches:
            roles = _roles(batch)
            for i, j, x in _rows_of(batch, "text", basis):
                for r, chosen in enumerate(roles):
                    part = x if r == _ALL else x[chosen[i:j]]
                    if len(part):
                        n[r] += len(part)
                        sums[r] += part.T @ part
        task = TaskContext.get().partitionId()
        for r in range(3):
            if n[r]:
                yield pa.RecordBatch.from_pydict({"role": [r], "task": [task], "n": [n[r]], "sums": [sums[r].tobytes()]}, schema=types)

    def added(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        total = sum(np.frombuffer(b.as_buffer(), np.float64) for b in group["sums"])
        return pa.Table.from_pydict({"role": [group["role"][0].as_py()], "task": [group["task"][0].as_py() // 64], "n": [sum(group["n"].to_pylist())], "sums": [total.tobytes()]}, schema=types)

    parts = rows.mapInArrow(run, schema)
    for _ in range(3):  # enough for 64**3 tasks
        parts = parts.groupBy("role", F.expr("task div 64")).applyInArrow(added, schema)
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["role"], r["task"])):
        n, sums = out.get(r["role"], (0, 0.0))
        out[r["role"]] = n + r["n"], sums + np.frombuffer(r["sums"], np.float64).reshape(SIZE, SIZE)
    return out


def score_counts(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by bins of the first classifier's score: trusted ones of the second half, and all."""

    def run(batches):
        basis, counts = Basis(), np.zeros((2, _BINS), np.int64)
        for batch in batches:
            roles = _roles(batch)
            for i, j, x in _rows_of(batch, "text", basis):
                bins = np.clip(((x @ weights + _REACH) * (_BINS / (2 * _REACH))).astype(np.int64), 0, _BINS - 1)
                for k, r in enumerate((_SECOND, _ALL)):
                    counts[k] += np.bincount(bins[roles[r][i:j]], minlength=_BINS)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(counts[k, b])], ["k", "b", "n"])

    found = rows.mapInArrow(run, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()  # at most two rows a bin
    counts = np.zeros((2, _BINS), np.int64)
    counts[found["k"], found["b"]] = found["n"]
    return counts[0], counts[1]


# ---- what the driver computes from the sums -------------------------------------------


def _ridge(positives: int) -> float:
    return _RIDGE + _RIDGE_DOCUMENTS / positives


def against_unlabelled(first: tuple[int, np.ndarray], everything: tuple[int, np.ndarray]) -> np.ndarray:
    """Weights of the squared-loss classifier of positives, 1, against unlabelled, -1, both groups weighing the same."""
    p, u = (m / n for n, m in (first, everything))
    return np.linalg.solve(p + u + _ridge(first[0]) * np.eye(len(u)), p[0] - u[0])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled, from both groups' counts by bins of a score: the least ratio, over
    thresholds, of the unlabelled share above a threshold to the positive share above it, with a bound on the errors."""
    n, m = positive.sum(), unlabelled.sum()
    if n < 2 or m < 2:
        return 0.5
    p, u = (c[::-1].cumsum()[::-1] / c.sum() for c in (positive, unlabelled))
    # thresholds that leave a twentieth of the positives or more
    cuts = (p >= 0.05) & (positive > 0)
    slack = np.sqrt(np.log(4 / confidence) / (2 * m)) + np.sqrt(np.log(4 / confidence) / (2 * n))
    best = int(np.argmin(np.where(cuts, (u + slack) / np.maximum(p, 1e-12), np.inf)))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of the positives as such, risk of the negatives as estimated, which may be below zero); p and u are mean
    products of the basis."""
    square = lambda m, sign: w @ m @ w + 2 * sign * (m[0] @ w) + 1  # noqa: E731  E[(g + sign)**2]
    return prior * square(p, -1), square(u, 1) - prior * square(p, 1)


def minimised(p: np.ndarray, u: np.ndarray, prior: float, ridge: float, steps: int = 500) -> np.ndarray:
    """Weights that minimise the non-negative risk. Where the unbiased one's minimum has a negative part below zero, steps
    go back along that part's gradient while it is, and down the positives' risk otherwise."""
    eye = np.eye(len(u))
    w = np.linalg.solve(u + ridge * eye, 2 * prior * p[0] - u[0])
    best, least = w, np.inf
    rate = 0.5 / np.linalg.eigvalsh(u + p + ridge * eye)[-1]
    for _ in range(steps):
        positive, negative = risk(w, p, u, prior)
        total = positive + max(0.0, negative) + ridge * (w @ w)
        if total < least:
            best, least = w, total
        if negative >= 0 and best is w and total <= least and np.allclose(2 * (u @ w + u[0]) - 4 * prior * p[0] + 2 * ridge * w, 0, atol=1e-9):
            break
        down_negative = 2 * (u @ w + u[0]) - 2 * prior * (p @ w + p[0])
        down = -down_negative if negative < 0 else 2 * prior * (p @ w - p[0]) + down_negative + 2 * ridge * w
        w = w - rate * down
    return best


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = 8_000) -> np.ndarray | None:
    """Weights of the basis, or None where there are no positives. At most max_positive trusted positives, those of the
    least hash, are looked up; everything else is summed over all documents of the training fold."""
    rows = id_text(docs).where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    ids = [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).collect()]
    if not ids:
        return None
    trusted = docs.sparkSession.createDataFrame([(i, True) for i in ids], "doc_id long, trusted boolean")
    rows = rows.join(F.broadcast(trusted), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = moments(rows)
    halves = [sums[r] for r in (_FIRST, _SECOND) if r in sums]
    if not halves:
        return None
    positives = sum(n for n, _ in halves), sum(m for _, m in halves)
    prior = class_prior(*score_counts(rows, against_unlabelled(halves[0], sums[_ALL])))
    return minimised(positives[1] / positives[0], sums[_ALL][1] / sums[_ALL][0], prior, _ridge(positives[0]))


def _scores(weights: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """With the squared loss the best output is twice the chance of a positive, less 1. Nine decimals, so that equal texts
    have equal scores whatever they are multiplied with."""
    return np.full(len(x), 0.5) if weights is None else np.round(np.clip((x @ weights + 1) / 2, 0, 1), 9)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text); labels (doc_id, quality).

    The score, 0 to 1, is computed from the text alone. held_out: crc32 of doc_id as text, modulo 5, is 0; those rows'
    labels are not learned from. predicted: 1 if score >= threshold. Null and empty texts are scored like any other;
    without labels to learn from every score is 0.5. Rows without doc_id are scored but not learned from. Repeated rows
    are scored each, extra columns are ignored, an empty table gives no rows. bounds: max_positive, the most labelled
    documents that are learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))

    def run(batches):
        basis = Basis()
        for batch in batches:
            for i, j, x in _rows_of(batch, "text", basis):
                score = _scores(shared.value, x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = id_text(docs).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more; see scored()."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))
    place = docs.columns.index("text")

    def run(batches):
        basis = Basis()
        for batch in batches:
            scores = [_scores(shared.value, x) for _, _, x in _rows_of(batch, place, basis)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)

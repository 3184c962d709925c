"""Quality rules: counts of the whole text, then a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into buckets. Two multinomials are estimated over them: the raw corpus, from all
documents, and the trusted target, from documents that are labelled good. A document's score is the mean over its
n-grams of log p(target) - log p(raw), so it does not depend on the text's length; documents below a fixed score go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, pieces, shingle_hashes, text_bytes
from .textstats import TextStats

BITS = 16
_SIZE = 1 << BITS
_SHIFT = np.uint64(64 - BITS)


def _buckets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unigram buckets, bigram buckets) of a piece's words; the bigram at a row's last word is -1."""
    one = (hashes >> _SHIFT).astype(np.int64)
    two = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        two[:-1] = (shingle_hashes(hashes, 2) >> _SHIFT).astype(np.int64) + _SIZE
        last = at[1:][at[1:] > at[:-1]] - 1
        two[last] = -1
    return one, two


def ngram_counts(docs: DataFrame, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts by bucket: over all documents, and over those whose doc_id is in trusted (sorted)."""

    def run(batches):
        stats = TextStats()
        raw, target = np.zeros(2 * _SIZE, np.int64), np.zeros(2 * _SIZE, np.int64)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            good = np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), trusted)
            for i, j in pieces(offs):
                lo = offs[i]
                hashes, _, _, at = stats.rule.words(data[lo : offs[j]], offs[i : j + 1] - lo)
                one, two = _buckets(hashes, at)
                chosen = np.repeat(good[i:j], np.diff(at))
                for grams in (one, two):
                    raw += np.bincount(grams[grams >= 0], minlength=2 * _SIZE)
                    target += np.bincount(grams[(grams >= 0) & chosen], minlength=2 * _SIZE)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    rows = id_text(docs).mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = rows.toPandas()  # at most 2 * 2**BITS rows
    raw, target = np.zeros(2 * _SIZE, np.int64), np.zeros(2 * _SIZE, np.int64)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, for words and pairs apart, with added smoothing."""
    out = np.zeros(2 * _SIZE)
    for part in (slice(0, _SIZE), slice(_SIZE, 2 * _SIZE)):
        p, q = (np.log(c[part] + smoothing) - np.log(c[part].sum() + smoothing * _SIZE) for c in (target, raw))
        out[part] = p - q
    return out


def trusted_ids(labels: DataFrame, max_trusted: int) -> np.ndarray:
    """Sorted doc_ids of the documents labelled good; beyond max_trusted those of the least hash."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).toPandas()
    return np.sort(rows["doc_id"].to_numpy(np.int64))


def judged(docs: DataFrame, labels: DataFrame, min_score: float = -0.15, min_words: int = 50, max_repeat_percent: int = 50, max_trusted: int = 50_000) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row of docs (doc_id, text); labels (doc_id, quality).

    Words are runs of characters other than ASCII white space. n_words; word_chars: code points in words; n_symbols:
    characters of #*$%&|<>; n_dup_lines: lines between newlines that have a word and equal an earlier one;
    n_repeat_words: words in 3-word windows that the text has twice or more. base_failed: fewer than min_words words,
    or more than max_repeat_percent percent of them repeated. kept: not base_failed, and a score of min_score or more.
    A text without words (null, empty, blank) scores 0 and fails. Without trusted documents every score is what
    smoothing leaves. The target is fitted on at most max_trusted labelled documents, the raw corpus on all rows.
    Repeated rows count each; extra columns are ignored; an empty table gives no rows.
    """
    raw, target = ngram_counts(docs, trusted_ids(labels, max_trusted))
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target) if target.any() else np.zeros(2 * _SIZE))

    def run(batches):
        stats, ratios = TextStats(), shared.value
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in pieces(offs):
                lo = offs[i]
                counts, hashes, at = stats(data[lo : offs[j]], offs[i : j + 1] - lo)
                one, two = _buckets(hashes, at)
                total = np.concatenate(([0.0], np.cumsum(ratios[one] + np.where(two >= 0, ratios[two], 0.0))))
                n = counts["n_words"]
                score = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, 2 * n - 1)
                failed = (n < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * n)
                base = [counts[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([ids[i:j], *(pa.array(b.astype(np.int64)) for b in base), pa.array(failed), pa.array(score), pa.array(~failed & (score >= min_score))], _NAMES)

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

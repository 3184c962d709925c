"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are the alphabet. Training words are streamed through the automaton, which tracks the longest match
that ends at each word; a match of a whole window marks all its words. Words that no item has reset the automaton, so
runs of item words that are shorter than the least window are skipped unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_GAPS, WordRule, id_text, pieces, text_bytes

#: The automaton is sent to every executor, so the benchmark's size is checked.
MAX_BENCHMARK_BYTES = 64 << 20


class ItemAutomaton:
    """Generalised suffix automaton over lists of word ids, with the items of each match."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: list[set] = [set() for _ in self.len]
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.len]
        self._name(items)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return cur

    def _state(self, to: dict, length: int) -> int:
        self.next.append(to)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.len[p] + 1)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _name(self, items) -> None:
        """Marks the states of the items' windows; self.items at a window's state, self.short at the shorter items' ends."""
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            at = 0
            for n, word in enumerate(words, 1):
                at = self.next[at][word]
                if n >= self.window:
                    self.items[self.at_length(at, self.window)].add(name)
            if 0 < len(words) < self.window:
                ends.setdefault(at, []).append((len(words), name))
        if ends:
            for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                self.short[state] = self.short[self.link[state]] + ends.get(state, [])

    def at_length(self, state: int, length: int) -> int:
        """The state of the last `length` words of a match in state."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def matches(self, words: list[int], hit: np.ndarray, offset: int, found: set) -> None:
        """Marks hit[offset:...] for every window that occurs in words and adds its items to found."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = long = 0
        for i, word in enumerate(words, offset + 1):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                long = length[state]
                to = nxt[state].get(word)
            if to is None:
                continue
            state, long = to, long + 1
            if long >= window:
                hit[i - long : i] = True
                found |= self.items[self.at_length(state, window)]
            for n, name in self.short[state]:
                if n <= long:
                    hit[i - n : i] = True
                    found.add(name)


def _load(benchmark: DataFrame, window: int):
    """Broadcasts (sorted word hashes, ids in that order, automaton, least window) of the benchmark."""
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_BENCHMARK_BYTES} are sent to every executor")
    rule, ids, items = WordRule(ALNUM_GAPS, lower=True), {}, []
    for name, text in sorted(rows.collect()):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = rule.words(raw, np.array([0, len(raw)]))[0].tolist()
        items.append((name, [ids.setdefault(w, len(ids)) for w in words]))
    items = [x for x in items if x[1]]
    hashes = np.array(sorted(ids), np.uint64)
    order = np.array([ids[h] for h in hashes.tolist()], np.int64)
    model = hashes, order, vars(ItemAutomaton(items, window)), min((min(window, len(w)) for _, w in items), default=window)
    return benchmark.sparkSession.sparkContext.broadcast(model)


def _model(shared):
    """What _load broadcast, on an executor; the automaton travels as its plain fields."""
    hashes, order, fields, least = shared.value
    automaton = ItemAutomaton.__new__(ItemAutomaton)
    vars(automaton).update(fields)
    return hashes, order, automaton, least


def _scan_piece(rule, data, offs, hashes, order, automaton, least):
    """Per row of a piece: n_words, hit flags, items; and the words' starts and ends."""
    words, starts, ends, at = rule.words(data, offs)
    hit = np.zeros(len(words), bool)
    found = [set() for _ in range(len(offs) - 1)]
    if len(hashes) and len(words):
        place = np.searchsorted(hashes, words)
        place[place == len(hashes)] = 0
        known = hashes[place] == words
        # runs of item words within a row
        edge = np.zeros(len(words) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], known[:-1]))
        first = np.flatnonzero(known & (~before | edge[:-1]))
        after = np.concatenate((known[1:], [False]))
        last = np.flatnonzero(known & (~after | edge[1:])) + 1
        long = last - first >= least
        first, last = first[long], last[long]
        row = np.searchsorted(at, first, "right") - 1
        ids = order[place]
        for d, a, b in zip(row.tolist(), first.tolist(), last.tolist()):
            automaton.matches(ids[a:b].tolist(), hit, a, found[d])
    return at, hit, found, starts, ends


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans for every row of docs (doc_id, text), against benchmark (item_id, text).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is `window`
    consecutive words of an item, or all words of a shorter one. n_hit counts the words inside any occurrence of a
    window; items holds the distinct item_ids, as strings in their order, of the windows that occur; spans holds the
    byte offsets (first, after) of maximal runs of hit words. Null and empty texts have no words. Items without words
    or without item_id match nothing; repeated items count once. Rows with the same doc_id are judged each by itself.
    Extra columns are ignored, empty tables give no rows or no hits.
    """
    shared = _load(benchmark, window)

    def run(batches):
        rule, model = WordRule(ALNUM_GAPS, lower=True), _model(shared)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in pieces(offs):
                lo = offs[i]
                at, hit, found, starts, ends = _scan_piece(rule, data[lo : offs[j]], offs[i : j + 1] - lo, *model)
                total = np.concatenate(([0], np.cumsum(hit)))
                spans = []
                for d in range(j - i):
                    one = []
                    if total[at[d + 1]] > total[at[d]]:
                        flags = np.diff(np.concatenate(([0], hit[at[d] : at[d + 1]].view(np.int8), [0])))
                        base = int(offs[i + d] - lo)
                        one = [{"first": int(starts[at[d] + a]) - base, "after": int(ends[at[d] + b - 1]) - base} for a, b in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1))]
                    spans.append(one)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,after:long>>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_share: float = 0.05) -> DataFrame:
    """docs without the documents of which max_share of the words or more are hit; other hit spans are cut from their texts.

    All columns stay as they are, but for the text of documents that lose a span. Nulls and empty texts pass."""
    shared = _load(benchmark, window)
    place = docs.columns.index("text")

    def run(batches):
        rule, model = WordRule(ALNUM_GAPS, lower=True), _model(shared)
        for batch in batches:
            data, offs = text_bytes(batch.column(place))
            keep, changed = np.ones(batch.num_rows, bool), {}
            for i, j in pieces(offs):
                lo = offs[i]
                at, hit, _, starts, ends = _scan_piece(rule, data[lo : offs[j]], offs[i : j + 1] - lo, *model)
                total = np.concatenate(([0], np.cumsum(hit)))
                for d in np.flatnonzero(total[at[1:]] > total[at[:-1]]):
                    n, n_hit = at[d + 1] - at[d], total[at[d + 1]] - total[at[d]]
                    if n_hit >= max_share * n:
                        keep[i + d] = False
                        continue
                    flags = np.diff(np.concatenate(([0], hit[at[d] : at[d + 1]].view(np.int8), [0])))
                    out, done = [], int(offs[i + d] - lo)
                    for a, b in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)):
                        out.append(data[lo + done : lo + starts[at[d] + a]].tobytes())
                        done = int(ends[at[d] + b - 1])
                    out.append(data[lo + done : offs[i + d + 1]].tobytes())
                    changed[i + d] = b"".join(out).decode("utf-8", "replace")
            if changed:
                texts = batch.column(place).to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

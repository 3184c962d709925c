"""Counts over whole texts, vectorised over many documents at a time."""

from __future__ import annotations

import numpy as np

from .common import SPACED, WordRule, _powers, mix, shingle_hashes

_ROW = np.uint64(0x9FB21C651E98DF25)
SYMBOLS = b"#*$%&|<>"


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


class TextStats:
    """Per row of a piece: counts (see NAMES), and the words' hashes for models over words."""

    NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_bangs", "n_chars", "n_distinct")

    def __init__(self):
        self.rule = WordRule(SPACED, lower=False)
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        codes[ord("\n")] = 0
        self.line_code = codes
        point = np.ones(256, bool)
        point[0x80:0xC0] = False
        self.tables = {
            "word_chars": point & self.rule.word,
            "n_symbols": _flags(SYMBOLS),
            "n_upper": _flags(bytes(range(ord("A"), ord("Z") + 1))),
            "n_lower": _flags(bytes(range(ord("a"), ord("z") + 1))),
            "n_digits": _flags(b"0123456789"),
            "n_marks": _flags(b".,;:"),
            "n_bangs": _flags(b"!?"),
            "n_chars": point,
        }

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(counts by name, word hashes, word offsets per row)."""
        rows = len(offs) - 1
        hashes, starts, _, at = self.rule.words(data, offs)
        out = {"n_words": np.diff(at)}
        histogram = np.array([np.bincount(data[offs[r] : offs[r + 1]], minlength=256) for r in range(rows)]).reshape(rows, 256)
        for name, members in self.tables.items():
            out[name] = histogram[:, members].sum(axis=1)
        row_of_word = np.repeat(np.arange(rows), out["n_words"])
        out["n_repeat_words"] = self._repeats(hashes, at, row_of_word, rows)
        # 40 bits of each hash tell the words of a row apart well enough for a ratio
        packed = np.sort((row_of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.ones(len(packed), bool)
        new[1:] = packed[1:] != packed[:-1]
        out["n_distinct"] = np.bincount((packed[new] >> np.uint64(40)).astype(np.int64), minlength=rows)
        out["n_lines"], out["n_dup_lines"] = self._lines(data, offs, starts, rows)
        return out, hashes, at

    @staticmethod
    def _keys(hashes, row) -> np.ndarray:
        return mix(hashes + (row.astype(np.uint64) + np.uint64(1)) * _ROW)

    def _firsts(self, hashes, row) -> np.ndarray:
        return np.unique(self._keys(hashes, row), return_index=True)[1]

    def _repeats(self, hashes, at, row_of_word, rows) -> np.ndarray:
        """Words inside 3-word windows that the row has twice or more."""
        if len(hashes) < 3:
            return np.zeros(rows, np.int64)
        windows = shingle_hashes(hashes, 3)
        inside = np.flatnonzero(row_of_word[2:] == row_of_word[:-2])
        keys = self._keys(windows[inside], row_of_word[inside])
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(len(hashes), bool)
        for j in range(3):
            hit[inside[again] + j] = True
        return np.bincount(row_of_word[hit], minlength=rows)

    def _lines(self, data, offs, word_starts, rows) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier line) per row."""
        n = len(data)
        if not n:
            return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        first = np.zeros(n + 1, bool)
        first[offs[:-1]] = True
        first[np.flatnonzero(data == 10) + 1] = True
        first = np.flatnonzero(first[:n])
        words = np.diff(np.searchsorted(word_starts, np.append(first, n))) > 0
        hashes = np.add.reduceat(self.line_code[data] * _powers(n)[0][:n], first)
        hashes *= _powers(n)[1][first]
        row = np.searchsorted(offs, first[words], "right") - 1
        hashes = mix(hashes[words])
        total = np.bincount(row, minlength=rows)
        return total, total - np.bincount(row[self._firsts(hashes, row)], minlength=rows)

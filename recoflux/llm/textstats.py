"""Counts over whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from . import common as C


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _set(b"#*$%&|<>")
UPPER, LOWER, DIGIT, BANG = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789"), _set(b"!?")
STOP = _set(b".,;:!?")


def _sums(hit: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(hit)))


def _repeats(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (text, key): whether it has an equal, and whether it is not the first of its equals."""
    order = np.lexsort((np.arange(len(key)), key, text))
    t, k = text[order], key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    again, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    again[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return again, later


class Stats:
    """Counts by text of one piece; each method computes only what it needs, once."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends, self.at = C.word_spans(raw, offsets)
        self.n_words = np.diff(self.at)
        self._hashes = None

    def per_text(self, hit: np.ndarray) -> np.ndarray:
        s = _sums(hit)
        return s[self.offsets[1:]] - s[self.offsets[:-1]]

    def per_word(self, hit: np.ndarray) -> np.ndarray:
        s = _sums(hit)
        return s[self.at[1:]] - s[self.at[:-1]]

    def n_bytes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word_chars(self) -> np.ndarray:
        return self.per_text(((self.raw & 0xC0) != 0x80) & ~C.SPACE[self.raw])

    def n_symbols(self) -> np.ndarray:
        return self.per_text(SYMBOL[self.raw])

    def count(self, table: np.ndarray) -> np.ndarray:
        return self.per_text(table[self.raw])

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = C.word_hashes(self.raw, self.starts, self.ends)
        return self._hashes

    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def caps_words(self) -> np.ndarray:
        """Words with two ASCII capitals or more and no small ASCII letter."""
        up, low = _sums(UPPER[self.raw]), _sums(LOWER[self.raw])
        return self.per_word((up[self.ends] - up[self.starts] >= 2) & (low[self.ends] == low[self.starts]))

    def capitalised(self) -> np.ndarray:
        return self.per_word(UPPER[self.raw[self.starts]] if len(self.starts) else np.zeros(0, bool))

    def distinct_words(self) -> np.ndarray:
        _, later = _repeats(self.word_text(), self.hashes())
        return self.n_words - self.per_word(later)

    def same_as_before(self) -> np.ndarray:
        """Words equal to the word before."""
        h, t = self.hashes(), self.word_text()
        same = np.zeros(len(h), bool)
        if len(h):
            same[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        return self.per_word(same)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: lines with a word, and those of them that equal an earlier one."""
        n = len(self.n_words)
        breaks = np.flatnonzero(self.raw == 10)
        begin = np.concatenate((self.offsets[:-1], breaks + 1))
        text = np.concatenate((np.arange(n), np.searchsorted(self.offsets, breaks, "right") - 1))
        order = np.lexsort((begin, text))
        begin, text = begin[order], text[order]
        last = np.ones(len(begin), bool)
        last[:-1] = text[1:] != text[:-1]
        end = np.where(last, self.offsets[text + 1], np.append(begin[1:], 1) - 1)
        some = np.searchsorted(self.starts, end) > np.searchsorted(self.starts, begin)
        begin, end, text = begin[some], end[some], text[some]
        key = C.run_hashes(self.raw, begin, end)
        _, later = _repeats(text, key)
        return np.bincount(text, minlength=n), np.bincount(text[later], minlength=n)

    def repeat_words(self, width: int = 8) -> np.ndarray:
        """Words in windows of `width` words that occur twice or more in the text."""
        h, n = self.hashes(), len(self.starts)
        if n < width:
            return np.zeros(len(self.n_words), np.int64)
        i = np.arange(n - width + 1)
        t = self.word_text()
        i = i[t[i] == t[i + width - 1]]
        again, _ = _repeats(t[i], C.window_hashes(h, i, width))
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, i[again], 1)
        np.add.at(cover, i[again] + width, -1)
        return self.per_word(np.cumsum(cover)[:n] > 0)

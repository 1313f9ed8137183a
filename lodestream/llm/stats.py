"""Counts per text and per line that the quality operators share."""

from __future__ import annotations

from collections import Counter

import numpy as np

from .textblock import LOWER, SPACE, U64, Words, covered, mix, owner, repeated, runs, strings, within

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTERS = UPPER.copy()
LETTERS[97:123] = True
LETTERS[0xC3:0xF5] = True  # first bytes of longer characters
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
BAR = np.zeros(256, bool)
BAR[list(b"|>")] = True
TAIL = np.zeros(256, bool)
TAIL[0x80:0xC0] = True  # second and later bytes of a character
NEWLINE = 10
#: Ends of a sentence for a line's last character, of one byte; `ended` adds closing quotes and the ellipsis.
TERMINAL = np.zeros(256, bool)
TERMINAL[list(b".!?:;\"')]}")] = True
OTHER = ~LETTERS & ~SPACE & ~TAIL
#: Phrases that only page furniture has, in lower case.
BOILERPLATE = (
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"cookie", b"enable javascript", b"lorem ipsum", b"click here",
    b"subscribe to", b"skip to content", b"back to top", b"powered by", b"share on", "\u00a9 20".encode(), b"copyright 20",
)


class Tally:
    """Where the bytes of each class stand, so that any range's counts are two binary searches. Dense classes are taken as complements of sparse ones."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self._at: dict[str, np.ndarray] = {}

    def __call__(self, kind: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if kind == "letters":
            return end - start - sum(self(k, start, end) for k in ("space", "tail", "other"))
        if kind == "word_chars":
            return end - start - self("space", start, end) - self("tail", start, end)
        if kind == "chars":
            return end - start - self("tail", start, end)
        if kind not in self._at:
            self._at[kind] = np.flatnonzero(CLASSES[kind][self.data])
        return within(self._at[kind], start, end)


CLASSES = {"space": SPACE, "tail": TAIL, "other": OTHER, "symbol": SYMBOL, "upper": UPPER, "digit": DIGIT, "stop": STOP, "bar": BAR, "shout": np.arange(256) == 33}


class Measured:
    """Words, lines and byte classes of one piece, found once."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self.words, self.tally = Words(data, off), Tally(data)
        self.hashes = self.words.hashes()
        start, end = runs(data != NEWLINE, off)
        words = within(self.words.start, start, end)
        full = words > 0
        self.line_start, self.line_end, self.line_words = start[full], end[full], words[full]
        self.line_doc = owner(off, self.line_start)
        key = strings(data, self.line_start, self.line_end) + mix(self.line_doc.astype(U64) + U64(1))
        self.line_again = np.zeros(len(key), bool)
        alike = np.flatnonzero(repeated(key))  # only these are compared, by their bytes
        raw, seen = data.tobytes() if len(alike) else b"", set()
        for i, d, a, b in zip(alike.tolist(), self.line_doc[alike].tolist(), self.line_start[alike].tolist(), self.line_end[alike].tolist(), strict=True):
            line = d, raw[a:b]
            self.line_again[i] = line in seen
            seen.add(line)

    def repeated_windows(self, k: int) -> np.ndarray:
        """Starts of the k-word windows that occur twice or more in their text. Fingerprints propose; words decide."""
        words = self.words
        at, fp = words.windows(self.hashes, k)
        key = fp + mix(words.doc.astype(U64) + U64(1))[at]
        _, first, like = np.unique(key, return_index=True, return_inverse=True)
        other = first[like] != np.arange(len(at))
        here, there = at[other], at[first[like[other]]]
        if not all(same_strings(self.data, words.start[here + j], words.end[here + j], words.start[there + j], words.end[there + j]).all() for j in range(k)):
            return self._repeated_windows_by_word(at, k)
        twice = np.zeros(len(at), bool)
        twice[other] = True
        twice[first[like[other]]] = True
        return at[twice]

    def _repeated_windows_by_word(self, at: np.ndarray, k: int) -> np.ndarray:
        raw, words = self.data.tobytes(), self.words
        each = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        keys = [(words.doc[i], *each[i : i + k]) for i in at.tolist()]
        count = Counter(keys)
        return at[np.array([count[x] > 1 for x in keys], bool)]


def same_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals data[other:other_end], for arrays of bounds."""
    size = end - start
    same = size == other_end - other
    size = np.where(same, size, 0)
    cut = np.cumsum(size)
    if len(cut) and cut[-1]:
        step = np.arange(cut[-1]) - np.repeat(cut - size, size)
        differ = data[np.repeat(start, size) + step] != data[np.repeat(other, size) + step]
        same[np.repeat(np.arange(len(size)), size)[differ]] = False
    return same


def per_text(m: Measured) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts of each text."""
    a, b, words = m.off[:-1], m.off[1:], m.words
    salt = mix(words.doc.astype(U64) + U64(1))
    again = np.flatnonzero(covered(len(words), m.repeated_windows(5), 5))
    first = np.unique(m.hashes + salt, return_index=True)[1]
    return {
        "n_words": words.counts(),
        "word_chars": m.tally("word_chars", a, b),
        "n_symbols": m.tally("symbol", a, b),
        "n_upper": m.tally("upper", a, b),
        "n_letters": m.tally("letters", a, b),
        "n_digits": m.tally("digit", a, b),
        "n_stops": m.tally("stop", a, b),
        "n_bars": m.tally("bar", a, b),
        "n_shouts": m.tally("shout", a, b),
        "n_chars": m.tally("chars", a, b),
        "n_lines": np.bincount(m.line_doc, minlength=m.n),
        "n_dup_lines": np.bincount(m.line_doc[m.line_again], minlength=m.n),
        "n_repeat_words": within(again, words.at[:-1], words.at[1:]),
        "n_distinct": np.bincount(words.doc[first], minlength=m.n),
    }


def ended(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each end closes a sentence: `TERMINAL`, \u00bb, \u201d or \u2026."""
    last, before, lead = (data[end - i] for i in (1, 2, 3))
    return TERMINAL[last] | (before == 0xC2) & (last == 0xBB) | (lead == 0xE2) & (before == 0x80) & ((last == 0x9D) | (last == 0xA6))


def failing_lines(m: Measured) -> np.ndarray:
    """A code for each line with words: 0 good, 1 navigation, 2 symbols, 3 shouting, 4 fragment, 5 boilerplate, 6 repeated."""
    start, end, n_words = m.line_start, m.line_end, m.line_words
    code = np.zeros(len(start), np.int8)
    if not len(start):
        return code
    bars, symbols, stops, shouts, letters, upper = (m.tally(k, start, end) for k in ("bar", "symbol", "stop", "shout", "letters", "upper"))
    closed = ended(m.data, m.words.end[np.searchsorted(m.words.start, end) - 1])
    code[m.line_again] = 6
    low = LOWER[m.data].tobytes()
    for phrase in BOILERPLATE:
        at = low.find(phrase)
        while at >= 0:
            i = int(np.searchsorted(start, at, "right")) - 1
            if i >= 0 and at + len(phrase) <= end[i]:
                code[i] = 5
            at = low.find(phrase, at + 1)
    code[(n_words < 4) & ~closed & (stops == 0)] = 4
    code[(n_words >= 4) & ((upper * 10 > letters * 7) & (letters > 0) | (shouts * 2 > n_words))] = 3
    code[symbols * 5 > n_words] = 2
    code[(bars >= 3) & (bars * 5 > n_words)] = 1
    return code

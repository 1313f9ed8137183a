"""Minimal acyclic transducer: words to rows of ids, in one flat file that can be memory-mapped.

States with equal futures are shared, so common suffixes are stored once. Each arc carries the
number of words that sort before those behind it; the sum along a word's path is the word's rank,
and the rank selects its ids.
"""

from __future__ import annotations

import mmap
from collections.abc import Sequence

import numpy as np

MAGIC = 0x4C45584943303031


def build(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """Compiles distinct words, sorted as bytes, and their ids."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # per state: ((label, target), ...), final
    counts: list[int] = []

    def state(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key)
            counts.append(final + sum(counts[t] for _, t in out))
        return register[key]

    path: list[list] = [[False, []]]  # open states of the last word: final, finished arcs
    last = b""
    for word in words:
        if word <= last and (last or path[0][0]):
            raise ValueError("words must be distinct and sorted")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, out)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, out = path.pop()
        path[-1][1].append((last[len(path) - 1], state(final, out)))
    root = state(*path[0])
    first, labels, targets, before = [0], bytearray(), [], []
    for final, out in arcs:
        rank = int(final)
        for label, target in out:
            labels.append(label)
            targets.append(target)
            before.append(rank)
            rank += counts[target]
        first.append(len(labels))
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if len(ids) else np.zeros(1)
    parts = [
        np.asarray(first, np.int32), np.asarray(targets, np.int32), np.asarray(before, np.int32), np.asarray(start, np.int32),
        np.asarray([i for x in ids for i in x], np.int32), np.asarray([f for f, _ in arcs], np.uint8), np.frombuffer(bytes(labels), np.uint8),
    ]
    head = np.array([MAGIC, root, *[len(p) for p in parts]], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reads a compiled lexicon from a memory-mapped file or from bytes."""

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, self.held = memoryview(source), source
        head = np.frombuffer(view[:72], np.int64).tolist()
        if head[0] != MAGIC:
            raise ValueError("not a lexicon")
        self.root, at, parts = head[1], 72, []
        for i, n in enumerate(head[2:]):
            size = n * (4 if i < 5 else 1)
            parts.append(view[at : at + size].cast("i") if i < 5 else view[at : at + size])
            at += size
        self.first, self.target, self.before, self.start, self.ids, self.final, labels = parts
        self.labels = bytes(labels)

    def rank(self, word: bytes) -> int:
        """The word's place among the words, -1 if it is none."""
        state, rank, first, find = self.root, 0, self.first, self.labels.find
        for label in word:
            arc = find(label, first[state], first[state + 1])
            if arc < 0:
                return -1
            rank += self.before[arc]
            state = self.target[arc]
        return rank if self.final[state] else -1

    def get(self, word: bytes) -> list[int] | None:
        rank = self.rank(word)
        return None if rank < 0 else self.ids[self.start[rank] : self.start[rank + 1]].tolist()

    def __len__(self) -> int:
        return len(self.start) - 1

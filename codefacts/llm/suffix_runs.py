"""Sorted runs of suffixes: front coding, and merging by a loser tree that keeps common prefixes.

In a run every string is stored as the length of the prefix that it shares with
the one before and the rest. Merging uses these lengths: two candidates that
share different prefixes with the last winner are ordered by the lengths alone,
and only candidates with equal ones are compared, from there on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

_HEAD = struct.Struct("<IIIIqq")


@dataclass(slots=True)
class Suffix:
    """``text``: the string from the anchor on, then what stands before it. ``before``: length of that part.

    ``count``: how often it was met; ``h1``, ``h2``: digest of text and ``before``; ``shared``: prefix shared with its predecessor.
    """

    text: bytes
    before: int
    count: int
    h1: int
    h2: int
    shared: int = 0


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    most = min(len(a), len(b))
    for at in range(start, most, 64):
        x, y = a[at : min(at + 64, most)], b[at : min(at + 64, most)]
        if x != y:
            differs = int.from_bytes(x) ^ int.from_bytes(y)
            return at + (8 * len(x) - differs.bit_length()) // 8
    return max(most, start)


def encode(run: list[Suffix]) -> bytes:
    """Front-coded bytes of a sorted run."""
    out, last = [], b""
    for s in run:
        shared = common_prefix(last, s.text)
        rest = s.text[shared:]
        out += [_HEAD.pack(shared, len(rest), s.before, s.count, s.h1, s.h2), rest]
        last = s.text
    return b"".join(out)


def decode(blob: bytes) -> Iterator[Suffix]:
    """The suffixes of a front-coded run, each with the prefix that it shares with its predecessor."""
    at, last = 0, b""
    while at < len(blob):
        shared, size, before, count, h1, h2 = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:shared] + blob[at : at + size]
        at += size
        yield Suffix(last, before, count, h1, h2, shared)


class LoserTree:
    """K-way merge of sorted runs.

    Every inner place keeps the loser of its comparison. ``shared`` of a
    candidate is its common prefix with the last winner that passed its place,
    so that most comparisons look at two numbers and no text.
    """

    def __init__(self, runs: list[Iterator[Suffix]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads: list[Suffix | None] = [next(r, None) for r in runs]
        self.shared = [0] * len(runs)
        self.tree = [-1] * self.k
        self.compared = 0
        self.winner = self._build(1) if runs else -1

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The smaller of two runs' heads goes on; the other stays as loser, with its prefix shared with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif self.shared[a] != self.shared[b]:
            # who shares more with the last winner is nearer to it, and so smaller
            win, lose = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            known = self.shared[a]
            self.compared += 1
            same = common_prefix(x.text, y.text, known)
            less = (x.text[same:], x.before) <= (y.text[same:], y.before)
            win, lose = (a, b) if less else (b, a)
            self.shared[lose] = same
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[Suffix]:
        """All suffixes in order; ``shared`` is the prefix shared with the suffix given out before."""
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            run = self.winner
            head.shared = self.shared[run]
            yield head
            following = next(self.runs[run], None)
            self.heads[run] = following
            self.shared[run] = following.shared if following else 0
            node = (run + self.k) // 2
            while node:
                run = self._play(node, self.tree[node], run)
                node //= 2
            self.winner = run


def merged(runs: list[Iterator[Suffix]]) -> Iterator[Suffix]:
    """Distinct suffixes of all runs in order, with their counts added up."""
    last: Suffix | None = None
    for s in LoserTree(runs):
        if last is not None and s.before == last.before and s.shared == len(s.text) == len(last.text):
            last.count += s.count
            continue
        if last is not None:
            yield last
        last = s
    if last is not None:
        yield last

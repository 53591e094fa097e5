"""Word shingles of whole texts as 64-bit numbers, a batch of texts at a time.

A word's number is a polynomial over its bytes, read off one running sum of the
batch; a shingle's number mixes those of its words. Equal shingles have equal
numbers; two different ones agree with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from codefacts.llm.common import SPACE, text_bytes

WIDTH = 5
#: Bytes of text handled at once; longer single texts are handled alone.
CHUNK = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)[_FOLD]
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _INVERSE) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next batch."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK), base)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_numbers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word, and where each row's words start; A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    powers, inverse = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=running[1:])
    numbers = (running[ends] - running[begins]) * inverse[begins]
    return mix(numbers + (ends - begins).astype(np.uint64)), np.searchsorted(begins, starts)


def shingle_numbers(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One number per run of ``width`` words; a shorter text as a whole is one; no word, none."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width * int(_BASE) % (1 << 64)))
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * _PLACES[i]
    return mix(total)


def shingle_sets(text: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle numbers of each text, in order; null counts as empty."""
    data, starts = text_bytes(text)
    at = 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, side="right")) - 1)
        words, first = word_numbers(data[starts[at] : starts[stop]], starts[at : stop + 1] - starts[at])
        for i in range(stop - at):
            yield np.unique(shingle_numbers(words[first[i] : first[i + 1]], width))
        at = stop


def to_signed(numbers: np.ndarray) -> np.ndarray:
    return numbers.view(np.int64)

"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from panelloom.llm.common import LOWER

# Texts are hashed together up to about this many bytes.
CHUNK = 1 << 19
# Fixed random numbers of the hashes.
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
LETTERS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
BASE = int(_RANDOM.integers(1, 1 << 63, dtype=np.uint64)) | 1
SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of the numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start, and their hashes: of the letters, each at its place in the word."""
    inside = ~SEPARATES[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    length = ends - starts
    letters = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(first, length)
    values = LETTERS[data[letters]] * powers(int(length.max()))[place]
    return starts, mixed(np.add.reduceat(values, first) + length.astype(np.uint64))


def shingle_sets(texts: Sequence[str], width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield from _sets(held, width)
            held, size = [], 0
    yield from _sets(held, width)


def _sets(held: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not held:
        return
    starts, words = word_hashes(np.frombuffer(b" ".join(held), np.uint8))
    begin = np.cumsum([0] + [len(b) + 1 for b in held])
    cut = np.searchsorted(starts, begin)
    places = np.resize(PLACES, width) if width > len(PLACES) else PLACES[:width]
    n = len(words) - width + 1
    shingles = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        shingles += words[i : i + n] * places[i]
    shingles = mixed(shingles)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            found = np.sort(shingles[a : b - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield mixed((words[a:b] * places[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)

"""Hashes of the words and word windows of many texts at once, in numpy."""

import numpy as np

# The six blanks of ASCII, and lower case for its letters only.
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def forget_powers() -> None:
    """Drop the powers, which are as many as the longest text has bytes."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_places(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes begin and end; the last byte is a blank."""
    blank = _IS_BLANK[joined]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, and where each text's words begin.

    The result has one bound more than texts. Long texts take some 60 bytes of memory per byte, so
    callers pass blocks of bounded size; a single longer text is handled whole.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_places(joined)
    power, inverse = _powers(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * power[:-1])])
    length = (ends - starts).astype(np.uint64)
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(_BASE))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return hashes, bounds


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of the windows of `size` words, in order; of all words if they are fewer."""
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(_BASE) + words[k : k + n])
    return np.unique(total)


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Stretches of about `most` in size, one or more items each."""
    found, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            found.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(sizes):
        found.append((start, len(sizes)))
    return found

"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import bytes_of

WORDS = 5
#: Bytes that are hashed at once.
PIECE = 1 << 18
# A-Z lower-cased, white space made one blank, all other bytes kept.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], dtype=np.uint8)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def _cut(data: np.ndarray, at: np.ndarray, a: int) -> int:
    """Where a piece that begins at a ends: behind white space or a text, within PIECE bytes if it can be."""
    b = a + PIECE
    if b >= len(data):
        return len(data)
    edge = int(at[np.searchsorted(at, b, "right") - 1])
    blanks = np.flatnonzero(_FOLD[data[max(a, edge) : b]] == 32)
    if (end := max(a, edge) + int(blanks[-1]) + 1 if len(blanks) else edge) > a:
        return end
    edge = int(at[np.searchsorted(at, b, "left")])
    while b < edge:  # one word of more than PIECE bytes
        blanks = np.flatnonzero(_FOLD[data[b : b + PIECE]] == 32)
        if len(blanks):
            return min(b + int(blanks[0]), edge)
        b += PIECE
    return edge


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[at[i]:at[i + 1]], and the number of words of each text.

    Bytes pass in pieces, so that only the hashes of a long text are held, eight bytes a word.
    """
    found, counts, a = [], np.zeros(len(at) - 1, dtype=np.int64), 0
    while a < len(data):
        b = _cut(data, at, a)
        x = _FOLD[data[a:b]]
        inside = x != 32
        first = np.zeros(len(x) + 1, dtype=bool)
        own = at[np.searchsorted(at, a, "left") : np.searchsorted(at, b, "right")]
        first[own - a] = True
        start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        power, inverse = powers(len(x) + 1)
        running = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[x] * power[: len(x)], out=running[1:])
        found.append(mix((running[end] - running[start]) * inverse[start]))
        counts += np.bincount(np.searchsorted(at, start + a, "right") - 1, minlength=len(counts))[: len(counts)]
        a = b
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64), counts


def shingle_sets(column, words: int = WORDS) -> list[np.ndarray]:
    """For each text of an Arrow column its set as ascending distinct 64-bit hashes.

    Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Fewer words than a shingle has: the whole
    sequence is the one member. No words, or null: empty. Two shingles share a hash by chance with a
    likelihood of about 2**-60.
    """
    data, at = bytes_of(column)
    word, counts = word_hashes(data, at)
    joined = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        joined += word[k : k + len(joined)] * _PLACE[k]
    joined = mix(joined)
    out, a = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(joined[a : a + n - words + 1]))
        elif n:  # its number of words is part of a short sequence
            out.append(mix((word[a : a + n] * _PLACE[:n]).sum(keepdims=True) + _PLACE[8 + n : 9 + n]))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        a += n
    return out

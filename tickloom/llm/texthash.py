"""Word and shingle hashes of many texts at once, in NumPy on the UTF-8 bytes.

A word is a run of bytes other than 20 and 09-0D (hex), with A-Z in lower case. Its hash is the sum, modulo 2^64, of a
mixed number for each byte and its place in the word, passed through a finaliser. Equal words have equal hashes; the
numbers follow no rule that repetitive words could meet (sums of constants times powers do), so two different words
share a hash as random numbers do, with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MOST = 1 << 22
#: Places in a word whose mixed numbers are looked up; later ones are mixed once more.
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _constants(split_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and each byte's class: 0 space, 1 word, 2 mark."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    lower = byte.copy()
    lower[65:91] = byte[97:123]
    kind = np.ones(256, dtype=np.int8)
    if split_marks:
        kind[:128] = 2
        kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return lower, kind


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    size, step = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * _U(step)
        step = step * step % (1 << 64)
        size *= 2
    return out


class WordHasher:
    """Holds the constants of one task. With split_marks, runs of ASCII punctuation are words of their own."""

    def __init__(self, split_marks: bool = False) -> None:
        byte, self.kind = _constants(split_marks)
        places = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
        self.mixed = mix(byte[None, :] ^ places[:, None]).ravel()

    def words(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of each text, and per text the number of words."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if int(lengths.sum()) > 2 * _MOST and len(starts) > 1:
            half = len(starts) // 2
            a, b = self.words(raw, starts[:half], lengths[:half]), self.words(raw, starts[half:], lengths[half:])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        # one space byte after each text keeps words of neighbours apart
        joined = np.full(int(lengths.sum()) + len(starts), 0x20, dtype=np.uint8)
        ends = np.cumsum(lengths + 1)
        if np.array_equal(starts[1:], starts[:-1] + lengths[:-1]):
            keep = np.ones(len(joined), dtype=bool)
            keep[ends - 1] = False
            joined[keep] = raw[starts[0] : starts[0] + int(lengths.sum())]
        else:
            for s, n, e in zip(starts.tolist(), lengths.tolist(), ends.tolist(), strict=True):
                joined[e - 1 - n : e - 1] = raw[s : s + n]
        n = len(joined)
        kind = self.kind[joined]  # the last byte is a space
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        first = edge[kind[edge] > 0]
        last = edge[kind[edge - 1] > 0]
        if kind[0]:
            first = np.concatenate([[0], first])
        # where each word's first byte is; bytes between words are never summed
        origin = np.zeros(n, dtype=np.int32)
        origin[first] = first
        place = np.arange(n, dtype=np.int32)
        place -= np.maximum.accumulate(origin)
        index = place & (_PLACES - 1)
        index <<= 8
        index |= joined
        number = self.mixed[index]
        if len(first) and int((last - first).max()) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            number[far] = mix(number[far] ^ mix((place[far] // _PLACES).astype(np.uint64)))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(number, out=total[1:])
        hashes = mix(total[last] - total[first])
        counts = np.searchsorted(first, ends) - np.searchsorted(first, ends - lengths - 1)
        return hashes, counts.astype(np.int64)


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, text by text, and their number per text.

    A text with fewer words gives its whole sequence as one shingle; a text without words gives none.
    """
    n = len(words)
    ends = np.cumsum(counts)
    multipliers = [_U(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(width)]
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    full = np.zeros(n, dtype=np.uint64)
    if n >= width:
        for k in range(width):
            full[: n - width + 1] += words[k : n - width + 1 + k] * multipliers[k]
        full = mix(full + _U(width))
    keep = np.zeros(n, dtype=bool)
    place = np.arange(n) - np.repeat(ends - counts, counts)
    keep[place < np.repeat(np.maximum(counts - width + 1, 0), counts)] = True
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short.tolist():  # at most width - 1 words each
        w = words[ends[i] - counts[i] : ends[i]]
        with np.errstate(over="ignore"):
            total = _U(0)
            for k, x in enumerate(w):
                total = total + x * multipliers[k]
            full[ends[i] - counts[i]] = mix(np.array([total + _U(len(w))], dtype=np.uint64))[0]
        keep[ends[i] - counts[i]] = True
    return full[keep], made

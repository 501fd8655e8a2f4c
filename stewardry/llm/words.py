"""Words of many texts at once: spans, 64-bit hashes and shingles, as whole-array operations.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes treat A-Z as a-z. A span's
hash is a chain of bijective mixers over its eight-byte blocks, a long one's is XXH3 of its
bytes. Equal hashes are taken for equal words where sets are compared; where the bytes
themselves matter (token ids), they are compared.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: bytes from which on a span is hashed by itself
LONG = 64

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of the length and the bytes of each span."""
    body = np.zeros(len(data) + 8, np.uint8)
    body[: len(data)] = LOWER[data] if fold else data
    blocks = np.ndarray((len(data) + 1,), "<u8", body.data, 0, (1,))  # the eight bytes from any place on
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]], 20240607)
    active, done = np.flatnonzero((sizes > 0) & (sizes <= LONG)), 0
    while len(active):
        left = sizes[active] - done
        block = blocks[starts[active] + done] & _MASK[np.minimum(left, 8)]
        out[active] = mix(out[active] ^ block)
        active, done = active[left > 8], done + 8
    return out


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end of every word of the texts laid end to end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = IS_WORD[data]
    edge = np.zeros(n, bool)  # a text begins here
    edge[offsets[:-1][offsets[:-1] < n]] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:]
    last[:-1] &= ~word[1:] | edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word, in order."""
    text, starts, ends = spans(data, offsets)
    return text, span_hashes(data, starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles.

    A text of fewer words has its whole sequence as its only shingle; one without words
    has none.
    """
    text, h = hashed(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    rolled = h.copy()
    for k in range(1, width):
        if len(h) > k:
            rolled[:-k] = mix(rolled[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            sh = rolled[a : b - width + 1].copy()
            sh.sort()
            keep = np.empty(len(sh), bool)
            keep[0] = True
            np.not_equal(sh[1:], sh[:-1], out=keep[1:])
            out.append(sh[keep])
        elif b > a:
            one = np.uint64(b - a)
            whole = mix(np.array([one]))
            for x in h[a:b]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(whole)
        else:
            out.append(h[:0])
    return out


class Known:
    """Values by 64-bit key in two sorted arrays: 16 bytes an entry."""

    def __init__(self, kind: type) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value where it is."""
        if len(self.keys) == 0:
            return np.zeros(len(keys), bool), np.zeros(len(keys), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, none of which is there."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.values = np.insert(self.values, at, values[order].astype(self.values.dtype))

"""Token ids of many texts by encoding each distinct piece of text once.

Byte-level vocabularies split a text by a pattern in which a blank may only begin a
match, and letters and punctuation never share one. A text can therefore be cut before a
single blank, around a single line feed, and between a letter and a stop, and be encoded
piece by piece with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from stewardry.llm import words

#: pieces of one generation that a worker process remembers; it keeps the one before as well
KNOWN = 300_000

_SOLID = np.zeros(256, bool)  # characters next to which a cut is safe
_SOLID[0x21:0x7F] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,!?;:"]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at every text, before a lone blank, around a lone line feed, and
    before a stop behind an ASCII letter.

    Letters beyond ASCII count as solid unless their character might be a blank of some
    script, which start with C2, E1, E2 or E3.
    """
    n = len(data)
    solid = _SOLID[data]
    high = data >= 0x80
    if high.any():
        risky = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
        near = risky.copy()
        near[1:] |= risky[:-1]
        near[2:] |= risky[:-2]
        solid = solid | (high & ~near)
    between = np.zeros(n, bool)
    between[1:-1] = solid[:-2] & solid[2:]
    begin = np.zeros(n + 1, bool)
    begin[:n] = between & ((data == 0x20) | (data == 0x0A))
    begin[1:n] |= _STOP[data[1:]] & _ASCII_LETTER[data[:-1]]
    begin[1:] |= np.append(between & (data == 0x0A), False)[:n]
    begin[offsets] = True
    begin[n] = False
    return np.flatnonzero(begin)


_encoders: dict[tuple, Encoder] = {}


def shared(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    """The worker process's encoder of that key, with what earlier tasks have learned."""
    if key not in _encoders:
        _encoders[key] = make()
    return _encoders[key]


def _places(bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts ``numbers`` of a joined array lie, one after another, and their sizes."""
    sizes = bounds[numbers + 1] - bounds[numbers]
    upto = np.cumsum(sizes) - sizes
    return np.repeat(bounds[numbers] - upto, sizes) + np.arange(int(sizes.sum())), sizes


class Pieces:
    """Bytes and ids of numbered pieces, each kind one after another; pieces are found by hash."""

    def __init__(self) -> None:
        self.number = words.Known(np.int64)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.body, self.edges = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def add(self, keys: np.ndarray, body: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces; of those that share a hash only the first can be found again."""
        numbers = len(self.bounds) - 1 + np.arange(len(keys))
        once, first = np.unique(keys, return_index=True)
        fresh = ~self.number.find(once)[0]
        self.number.add(once[fresh], numbers[first[fresh]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.body = np.concatenate([self.body, body])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(lengths)])
        return numbers

    def find(self, keys: np.ndarray, body: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of the pieces ``which`` is there, byte by byte, and its number."""
        met, number = self.number.find(keys[which])
        hits = np.flatnonzero(met)
        same = edges[which[hits] + 1] - edges[which[hits]] == np.diff(self.edges)[number[hits]]
        met[hits[~same]] = False
        hits = hits[same]
        if len(hits):
            here, lengths = _places(edges, which[hits])
            there, _ = _places(self.edges, number[hits])
            differ = np.concatenate([[0], np.cumsum(body[here] != self.body[there])])
            upto = np.concatenate([[0], np.cumsum(lengths)])
            met[hits[differ[upto[1:]] > differ[upto[:-1]]]] = False
        return met, number

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, one after another, and how many each has."""
        source, sizes = _places(self.bounds, numbers)
        return self.ids[source], sizes


class Encoder:
    """Ids of texts through ``encode``, which takes pieces (bytes) and returns their ids.

    Pieces are remembered in two generations; what is met again moves to the young one, so
    frequent pieces stay while memory is bounded. A piece is looked up by a hash and taken
    for known only if its bytes are the same.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.young, self.old = Pieces(), Pieces()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's begin and end."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = cuts(data, offsets)
        limits = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        back = pieces.indices.to_numpy()
        edges = np.frombuffer(pieces.dictionary.buffers()[1], np.int64)[: len(pieces.dictionary) + 1]
        body = np.frombuffer(pieces.dictionary.buffers()[2], np.uint8)[: edges[-1]]
        keys = words.span_hashes(body, edges[:-1], edges[1:], fold=False)
        if len(self.young.bounds) > KNOWN:
            self.young, self.old = Pieces(), self.young
        young, everything = self.young, np.arange(len(keys))
        met, index = young.find(keys, body, edges, everything)
        index = np.where(met, index, 0)
        missing = everything[~met]
        again, number = self.old.find(keys, body, edges, missing)
        if again.any():
            moved = missing[again]
            place, lengths = _places(edges, moved)
            index[moved] = young.add(keys[moved], body[place], lengths, *self.old.of(number[again]))
        new = missing[~again]
        if len(new):
            place, lengths = _places(edges, new)
            ids = self.encode(pieces.dictionary.take(pa.array(new)).to_pylist())
            sizes = np.array([len(x) for x in ids], np.int64)
            joined = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            index[new] = young.add(keys[new], body[place], lengths, joined, sizes)
        out, sizes = young.of(index[back])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return out, upto[np.searchsorted(starts, offsets)]

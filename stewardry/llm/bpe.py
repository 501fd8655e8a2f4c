"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The last token of a prefix's encoding is the one suffix of it that the token before may
stand next to, where two tokens may stand side by side if their joint bytes encode to just
them. A state of the transducer is the bytes still pending: reading a byte extends them and
sends out every token on which all possible continuations agree. Once they agree on a
boundary, no merge crosses it, so what follows is encoded as if it were the beginning. The
lookahead is at most the longest token. States and moves are made when first needed and
kept.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.chunks import Encoder, shared
from stewardry.llm.frames import flat, slices

#: states kept before the transducer starts afresh
STATES = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {r: t for t, r in ranks.items()}
        #: proper prefixes of tokens: pending bytes that a longer token might go on from
        self.open = {t[:i] for t in ranks for i in range(1, len(t))}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: per state: the pending bytes, the last token of each prefix of them (None where no
        #: encoding in question ends), and the prefixes from whose end a longer token may be
        #: under way
        self.states: list[tuple[bytes, list[int | None], list[int]]] = [(b"", [None], [])]
        self.numbers: dict[bytes, int] = {b"": 0}
        #: per state: byte -> (next state, tokens sent out)
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: list[tuple[int, ...] | None] = [()]

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of least rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(
                ((self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """Whether ``a`` may stand before ``b``."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.spelled[a] + self.spelled[b]) == [a, b]
        return ok

    def _chain(self, last: list[int | None], end: int) -> tuple[int, ...]:
        """The tokens that encode the first ``end`` pending bytes."""
        tokens = []
        while end > 0:
            tokens.append(last[end])
            end -= self.size[last[end]]
        return tuple(tokens[::-1])

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        pending, last, live = self.states[state]
        n = len(pending)
        pending += bytes((byte,))
        found = None
        for q in (*live, n):  # the longest suffix first
            token = self.ranks.get(pending[q:])
            if token is not None:
                if q == 0 or self.beside(last[q], token):
                    found = token
                    break
        last = [*last, found]
        live = [q for q in (*live, n) if pending[q:] in self.open]
        # where the encodings of all prefixes that matter meet
        cut, others = n + 1, live[:]
        while others:
            top = others[-1]
            if top == cut:
                others.pop()
            elif top > cut:
                others[-1] = top - self.size[last[top]]
                others.sort()
            else:
                cut -= self.size[last[cut]]
        sent: tuple[int, ...] = ()
        if cut:
            sent = self._chain(last, cut)
            pending = pending[cut:]
            useful = set()
            for end in (*live, n + 1):
                while end > cut and end not in useful:
                    useful.add(end)
                    end -= self.size[last[end]]
            last = [None] + [last[e] if e in useful else None for e in range(cut + 1, n + 2)]
            live = [q - cut for q in live]
        number = self.numbers.get(pending)
        if number is None:
            number = self.numbers[pending] = len(self.states)
            self.states.append((pending, last, live))
            self.moves.append({})
            self.finals.append(None)
        move = self.moves[state][byte] = (number, sent)
        return move

    def _finish(self, state: int) -> tuple[int, ...]:
        pending, last, _ = self.states[state]
        final = self.finals[state] = self._chain(last, len(pending))
        return final

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                move = self._make(state, byte)
            state, sent = move
            if sent:
                out.extend(sent)
        final = self.finals[state]
        out.extend(final if final is not None else self._finish(state))
        return out


def splitter(pattern: str):
    """The pattern's matches in a text; blanks are those of Unicode's White_Space."""
    import regex

    own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(own).findall


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    machine, split = Transducer(ranks), splitter(pattern)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        out = []
        for piece in pieces:
            ids: list[int] = []
            for match in split(piece.decode()):
                ids += machine.encode(match.encode())
            out.append(ids)
        return out

    coder = Encoder(encode)
    coder.decoder = Decoder(ranks)
    return coder


class Decoder:
    """Bytes of token ids, and the text they spell so far: characters cut between two calls
    wait in an incremental UTF-8 machine until they are whole."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        spelled = [b""] * size
        for t, r in ranks.items():
            spelled[r] = t
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in spelled])])
        self.body = np.frombuffer(b"".join(spelled), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        start = self.bounds[ids]
        size = self.bounds[ids + 1] - start
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.body[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].tobytes()

    def stream(self, ids: np.ndarray, step: int = 8192) -> Iterator[tuple[bytes, str]]:
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for at in range(0, max(len(ids), 1), step):
            part = self.bytes_of(ids[at : at + step])
            yield part, machine.decode(part, at + step >= len(ids))


CODED = "doc_id long, ids array<int>, decoded binary, decoded_text string"
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared(("bpe", path, pattern), lambda: encoder(load_ranks(path), pattern))
        decode = encode.decoder
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encode(*flat(batch.column("text")))
                body, texts = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    parts, spelled = zip(*decode.stream(ids[a:b]), strict=True)
                    body.append(b"".join(parts))
                    texts.append("".join(spelled))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists, pa.array(body, pa.binary()), pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "decoded", "decoded_text"],
                )

    return run


def _digests(coded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in coded:
        doc_id, lists, body, texts = batch.columns
        ids, bounds = lists.values.to_numpy(), lists.offsets.to_pylist()
        own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                doc_id, pa.array(map(len, own), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]),
                pa.array([hashlib.sha256(x).hexdigest() for x in body.to_pylist()]), pa.array(map(len, texts.to_pylist()), pa.int64()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
        )


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded, decoded_text`` for every row: the ids, and the bytes and the
    text that they spell.

    Ids by the ranks of ``vocabulary`` (a path that every worker has, a tiktoken file), each
    match of ``pattern`` by itself and no special tokens; then decoded again. A null text
    counts as empty and has no ids. Repeated rows give repeated results, an empty table
    none; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(_coded(vocabulary, pattern), CODED)


def code_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars`` for every row: digests
    of the rows of ``encode_documents``, made where those are."""
    coded = _coded(vocabulary, pattern)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(lambda batches: _digests(coded(batches)), OUT)

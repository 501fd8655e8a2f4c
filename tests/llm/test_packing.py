import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stewardry.llm import packing
from stewardry.llm.chunks import cuts
from stewardry.llm.frames import flat

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check(docs, pieces, tokenizer, length=packing.LENGTH):
    ids = [
        (r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
        for r in docs.select("doc_id", "text").collect()
    ]
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, own in by_doc.items():
        texts = [x for i, x in ids if i == doc]
        for p in own:  # repeated ids: each piece belongs to one of its texts
            assert any(
                len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in texts
            )
        if len(texts) == 1:
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append(p)
    padding = 0
    for own in used.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert 0 < total <= length
        padding += 0 if total & (total - 1) == 0 else length - total
    return padding


def test_packs_the_corpus(corpus, tokenizer):
    pieces = packing.pack_documents(corpus, VOCABULARY).collect()
    padding = check(corpus, pieces, tokenizer)
    assert padding <= 0.005 * sum(p.length for p in pieces)


def test_odd_rows(odd, nothing, tokenizer):
    check(odd, packing.pack_documents(odd, VOCABULARY, group=4).collect(), tokenizer)
    assert packing.pack_documents(nothing, VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_pack_covers_every_item_once(sizes):
    rows = packing.pack(sizes, 64, 1)
    seen = defaultdict(list)
    for row in rows:
        total = sum(t - s for _, s, t in row)
        assert 0 < total <= 64 and (total == 64 or total & (total - 1) == 0)
        for i, s, t in row:
            assert s < t
            seen[i].append((s, t))
    for i, n in enumerate(sizes):
        parts = sorted(seen.get(i, []))
        assert [s for s, _ in parts] == ([0, *[t for _, t in parts[:-1]]] if n else [])
        assert (parts[-1][1] if parts else 0) == n


def test_tournament_finds_the_first_fit():
    rng = np.random.default_rng(1)
    tree, free = packing.Tournament(50, 100), [100] * 50
    for size in rng.integers(1, 60, 80).tolist():
        first = next(i for i, f in enumerate(free) if f >= size)
        assert tree.first_fit(size) == first
        free[first] -= size


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from([*"ab1 \n\t'.\u00a0\u2003é日🙂\x1c", " a", "\n", "<|endoftext|>"]), max_size=30).map("".join),
        min_size=1, max_size=6,
    )
)
def test_pieces_encode_like_the_whole(tokenizer, texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    starts = cuts(data, offsets) if len(data) else [0]
    ids = []
    body = data.tobytes()
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        ids += tokenizer.encode(body[a:b].decode(), add_special_tokens=False).ids
    whole = [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
    assert ids == whole


def test_sequences_hold_their_ids(spark, corpus, odd, tokenizer):
    for docs in (corpus, odd):
        texts = docs.select("doc_id", "text").collect()
        encoded = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in texts]
        whole = defaultdict(list)
        pieces = packing.pack_documents(docs, VOCABULARY, group=64).collect()
        for p in sorted(pieces, key=lambda p: p.start):
            whole[p.doc_id] += p.ids
            assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        once = [i for i, _ in encoded if [j for j, _ in encoded].count(i) == 1]
        assert all(whole[i] == ids for i, ids in encoded if i in once)
        assert any(p.length == packing.LENGTH for p in pieces)

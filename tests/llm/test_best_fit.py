import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stewardry.llm import best_fit
from stewardry.llm.chunks import cuts
from stewardry.llm.frames import apart, flat

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check(docs, pieces, tokenizer, length=best_fit.LENGTH):
    """Every id in exactly one piece, only long documents cut, sequences gapless; their number."""
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, best_fit.END_ID]
        for n, s in enumerate(range(0, len(ids), length)):
            part = ids[s : s + length]
            want.append((r.doc_id, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    got = [(p.doc_id, p.piece, p.start, p.length, p.ids_crc32, p.ids) for p in pieces]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append(p)
    for own in used.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) <= length
    return len(used)


def test_packs_the_corpus(corpus, tokenizer):
    pieces = best_fit.pack_whole(corpus.repartition(7), VOCABULARY).collect()
    total = sum(p.length for p in pieces)
    assert check(corpus, pieces, tokenizer) <= -(-total // best_fit.LENGTH) + 1


def test_odd_rows(odd, nothing, tokenizer):
    check(odd, best_fit.pack_whole(odd, VOCABULARY, length=64, group=4).collect(), tokenizer, 64)
    assert best_fit.pack_whole(nothing, VOCABULARY).count() == 0


def test_bins_that_no_group_can_fill(spark, sf_dir, tokenizer):
    """All documents of two thirds of a bin: rounds end, one bin each."""
    docs = spark.createDataFrame([(i % 3, "word " * 20) for i in range(200)], "doc_id long, text string")
    assert check(docs, best_fit.pack_whole(docs, VOCABULARY, length=30, group=8).collect(), tokenizer, 30) == 200


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_search_never_loses(sizes):
    start = best_fit.best_fit(sizes, 64)
    found = best_fit.pack(sizes, 64)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in found)
    assert -(-sum(sizes) // 64) <= len(found) <= len(start)


def test_search_empties_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(500, 2500, 600).tolist()
    start = best_fit.best_fit(sizes, 4096)
    assert len(best_fit.pack(sizes, 4096)) < len(start)


@pytest.mark.parametrize(
    "sizes, bins, kind",
    [
        ([50, 50, 40, 60, 30], [[0, 1], [2], [3, 4]], "move or swap"),
        ([60, 30, 45, 50], [[0, 1], [2, 3]], "one for one"),
        ([90, 5, 4, 2], [[0, 1], [2, 3]], "two for one"),
    ],
)
def test_steps_grow_the_squares(sizes, bins, kind):
    search = best_fit.LocalSearch(sizes, bins, 100)
    squares = lambda: int(((search.length - search.free) ** 2).sum())
    for giver in range(len(bins)):
        own = np.flatnonzero(search.home == giver)
        step = search._step(giver, own) if len(own) else None
        if step is None:
            continue
        before = squares()
        to, gives, takes = step
        search.home[gives], search.home[takes] = to, giver
        search.free = 100 - np.bincount(search.home, search.size, len(bins)).astype(np.int64)
        assert squares() > before and (search.free >= 0).all()


def test_equal_rows_are_dealt_apart():
    deals = np.array([5, 7, 5, 5, 9])
    assert len(set(apart(deals).tolist())) == 5
    assert sorted(apart(deals)) == sorted(apart(deals[::-1]))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from([*"abΣ1 \n\t'.!  ́é日🙂\x1c", " a", "\n", "'s", "<|endoftext|>"]), max_size=30).map("".join),
        min_size=1, max_size=6,
    )
)
def test_pieces_of_text_encode_like_the_whole(tokenizer, texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    starts = cuts(data, offsets) if len(data) else [0]
    body, ids = data.tobytes(), []
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        ids += tokenizer.encode(body[a:b].decode(), add_special_tokens=False).ids
    assert ids == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stewardry.llm import bpe
from stewardry.llm.frames import flat

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encode(ranks):
    return bpe.encoder(ranks, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aetionshd1é日🙂\u00a0\x1c"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_like_the_library(encode, reference, texts):
    ids, bounds = encode(*flat(pa.array(texts, pa.string())))
    for a, b, text in zip(bounds[:-1], bounds[1:], texts, strict=False):
        assert ids[a:b].tolist() == reference.encode_ordinary(text)


def test_transducer_is_the_definition(ranks):
    machine = bpe.Transducer(ranks)
    rng = np.random.default_rng(4)
    for _ in range(400):
        piece = bytes(rng.choice(list(b"thetionnd ers\xc3\xa9\xff"), int(rng.integers(1, 40))).tolist())
        whole = ranks.get(piece)
        assert machine.encode(piece) == ([whole] if whole is not None else machine.merged(piece))


@pytest.mark.parametrize("step", [1, 2, 3, 50])
def test_streaming_decode(ranks, reference, step):
    text = "naïve 日本語 🙂🙃 Ωmega \n\n end"
    ids = np.array(reference.encode_ordinary(text))
    parts = list(bpe.Decoder(ranks).stream(ids, step))
    assert "".join(t for _, t in parts) == text
    assert b"".join(b for b, _ in parts) == text.encode()


def test_documents(corpus, odd, nothing, reference):
    for docs in (corpus, odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(reference.encode_ordinary(r.text or ""), "<u4")
            want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), len(r.text or "")))
        got = [tuple(r) for r in bpe.code_documents(docs, PATH, public_tokenizers.PATTERN).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.code_documents(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_and_decoded_text_are_given(corpus, odd, nothing, reference):
    for docs in (corpus, odd):
        want = [(r.doc_id, reference.encode_ordinary(r.text or ""), (r.text or "").encode(), r.text or "") for r in docs.select("doc_id", "text").collect()]
        out = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded), r.decoded_text) for r in out), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(nothing, PATH, public_tokenizers.PATTERN).count() == 0

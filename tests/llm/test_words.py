"""Hashes and piece memories under words made to collide."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from stewardry.llm import bpe, chunks, imatch, jaccard, packing, suffix_lm, words
from stewardry.llm.frames import flat

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def thue_morse(letters):
    """The word of a/b in which a polynomial modulo a power of two takes the same value as in its complement."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < letters:
        word += word.translate(swap)
    return word, word.translate(swap)


PAIRS = [thue_morse(n) for n in (64, 1024, 2048, 4096)]
TEXTS = [w for pair in PAIRS for w in pair]


@pytest.fixture(scope="module")
def twins(spark, sf_dir):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_no_two_hashes_agree():
    data, offsets = flat(pa.array(TEXTS, pa.string()))
    assert len(set(words.hashed(data, offsets)[1].tolist())) == len(TEXTS)


def test_a_span_s_hash_does_not_depend_on_its_place():
    text = ["Ab", "a" * 8, "x" * 9, "y" * 64, "z" * 65, "é🙂", "ab"]
    joined = words.hashed(*flat(pa.array([" ".join(text)])))[1]
    alone = np.concatenate([words.hashed(*flat(pa.array([t])))[1] for t in text])
    assert joined.tolist() == alone.tolist() and joined[0] == joined[-1]


def test_packing_gives_each_its_own_ids(twins):
    t = Tokenizer.from_file(VOCABULARY)
    got = {}
    for p in sorted(packing.pack_documents(twins, VOCABULARY).collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(p.ids)
    assert got == {i: [*t.encode(w, add_special_tokens=False).ids, 0] for i, w in enumerate(TEXTS)}


def test_bpe_gives_each_its_own_ids(twins):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in bpe.encode_documents(twins, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == own.encode_ordinary(TEXTS[r.doc_id]) and r.decoded_text == TEXTS[r.doc_id]


def test_jaccard_keeps_them_apart(twins):
    assert all(r.component_id == r.doc_id for r in jaccard.jaccard_components(twins).collect())


def test_language_model_and_fingerprints_tell_them_apart(twins):
    scored = suffix_lm.score(twins, suffix_lm.learn(twins)).collect()
    assert len(scored) == len(TEXTS)
    marks = imatch.edited_likeness(twins, imatch.lexicon(twins)).collect()
    assert len(marks) == len(TEXTS)


def test_encoder_compares_bytes(monkeypatch):
    """Even with eight hash values for all pieces, ids and boundaries are right."""
    real = words.span_hashes
    monkeypatch.setattr(words, "span_hashes", lambda *a, **b: real(*a, **b) & np.uint64(7))
    monkeypatch.setattr(chunks, "KNOWN", 20)
    t = Tokenizer.from_file(VOCABULARY)
    encode = packing._tokenizer(VOCABULARY)
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "a", "cat,", "sat", "on\nit", "mat.", "", "é"], 12)) for _ in range(5)]
        ids, bounds = encode(*flat(pa.array(texts)))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids

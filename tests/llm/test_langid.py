import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stewardry.llm import langid
from stewardry.llm.frames import flat, table


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.rejected for r in out]) < 0.01


def test_odd_rows(spark, corpus, odd, nothing):
    model = langid.learn(corpus)
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    for i in (3, 4, 5, 8):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in out} <= {"und", "en", "fr", "de", "es"}
    kept = langid.without_rejected(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.rejected}
    assert langid.identify(nothing, model).count() == 0


def test_nothing_to_learn(odd, nothing):
    assert langid.learn(nothing) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_other_script_is_rejected(spark, corpus):
    model = langid.learn(corpus)
    df = spark.createDataFrame([(1, "漢字仮名交じり文書体系言語" * 20), (2, corpus.first().text)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in langid.identify(df, model).collect()} == {1: True, 2: False}


def test_counts_do_not_cross_texts():
    texts = ["abc", "", "de", "A bc"]
    one = langid.counts(*flat(pa.array(texts)))
    alone = np.vstack([langid.counts(*flat(pa.array([t]))) for t in texts])
    assert (one == alone).all() and one[0].sum() == 3 and one[1].sum() == 0


def test_latin_foreign_and_random_text_is_rejected(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs)
    rng = np.random.default_rng(7)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 600).tolist())
    foreign = [
        letters, letters[:120],
        "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 600).tolist()),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
        "i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin näihin vapauksiin.",
    ]
    df = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(df, model).collect())
    held = [r for r in langid.identify(docs, model).collect() if r.held_out]
    assert np.mean([r.rejected for r in held]) < 0.02
    # beginnings of clean texts stay as well
    short = spark.createDataFrame([(r.doc_id, r.text[:100]) for r in docs.collect() if r.text and r.text.strip()], "doc_id long, text string")
    short = [r for r in langid.identify(short, model).collect() if r.held_out]
    assert np.mean([r.rejected for r in short]) < 0.03


WORDS = {
    "en": "the quick brown fox jumps over the lazy dog and then it goes home again",
    "fr": "le renard brun saute par dessus le chien paresseux et puis il rentre chez lui",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und geht dann nach hause",
}


def some(lang, i):
    own = WORDS[lang].split()
    return " ".join(own[(i * k) % len(own)] for k in range(3, 12))


def test_null_and_repeated_ids_lose_no_language(spark):
    """Rows without an id, or with one for all, give a sample like any others."""
    one, two = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(None, some("en", i), "en") for i in range(3000)] + [(one, some("fr", i), "fr") for i in range(3000)]
    rows += [(two, some("de", 1), "de")] * 3000  # one row, repeated
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.names) == {"en", "fr", "de"}


def test_many_languages(spark):
    """Rare values of ``lang`` are learned as well, up to the stated bound."""
    rows = [(8 * i, some("en", i) + f" l{i % 700}", f"l{i % 700}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert set(langid.learn(docs).names) == {r[2] for r in held}
    assert len(set(langid.learn(docs, languages=10).names)) == 10


def grams_of(text):
    """The grams of one text, byte by byte."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in text.encode()]
    found = np.zeros(langid.DIMS)
    for width in (2, 3):
        for at in range(len(data) - width + 1):
            part = data[at : at + width]
            if any(part):
                code = int.from_bytes(bytes(part), "big") + width
                place = int(langid.words.mix(np.array([code], np.uint64))[0] >> np.uint64(8)) % langid.DIMS
                found[place] += 1
    return found


def test_predictions_equal_brute_force(corpus):
    """One text at a time against one centroid at a time; document frequencies counted anew."""
    model = langid.learn(corpus)
    texts = {r.doc_id: r for r in corpus.select("doc_id", "text", "lang").collect()}
    letter = lambda t: t is not None and any(c.isalpha() for c in t)
    own = {i: grams_of(r.text) for i, r in texts.items() if letter(r.text) and len(r.text) < 5000}
    learned = [r for r in texts.values() if letter(r.text) and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    df = sum((grams_of(r.text) > 0).astype(int) for r in learned)
    idf = np.log((1 + len(learned)) / (1 + df)) + 0.1
    assert np.allclose(idf, model.idf, rtol=1e-4)
    for r in langid.identify(corpus, model).collect():
        if r.doc_id not in own:
            assert letter(texts[r.doc_id].text) or (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = [np.log1p(n) * w for n, w in zip(own[r.doc_id], idf, strict=True)]
        size = max(sum(v * v for v in x) ** 0.5, 1e-12)
        cosines = [float(np.dot(x, c)) / size for c in model.centres]
        assert abs(max(cosines) - r.score) < 1e-3
        assert cosines[model.names.index(r.lang_pred)] > -1 and max(cosines) - max(c for c, n in zip(cosines, model.names, strict=True) if n == r.lang_pred) < 1e-3


def test_clashing_names(spark, corpus):
    odd_names = corpus.limit(20).withColumn("_llm_letter", F.lit("own")).withColumn("rejected", F.lit(1))
    kept = langid.without_rejected(odd_names, langid.learn(corpus))
    assert kept.columns == odd_names.columns and {r._llm_letter for r in kept.collect()} <= {"own"}

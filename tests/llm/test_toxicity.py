import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stewardry.llm import toxicity
from stewardry.llm.frames import table

INSULTS = ["idiot", "moron", "clown", "loser", "pathetic", "worthless"]


def sentences(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "is"]
    out = []
    for i in range(n):
        own = ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for word in rng.choice(INSULTS, 2):
                own.insert(int(rng.integers(0, 30)), str(word))
        out.append((" ".join(own[:15]).capitalize() + ". " + " ".join(own[15:]) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit(sentences(1, 400))


def scores(machine, texts):
    return machine.score(toxicity.worst_words(machine, pa.array(texts, pa.string())))


def test_new_sentences(machine):
    fresh = sentences(2, 400)
    bad = scores(machine, [t for t, _ in fresh]) >= toxicity.THRESHOLD
    label = np.array([y for _, y in fresh]) == 1
    assert bad[label].mean() > 0.95 and bad[~label].mean() < 0.02


@pytest.mark.parametrize("text", ["IDIOT!", "i.d.i.o.t", "i d i o t", "idi*ot", "mor-on", "clowwn", "worthlesss", "an, loser?"])
def test_gapped_and_inserted(machine, text):
    assert scores(machine, [text])[0] >= toxicity.THRESHOLD


def test_clean_and_empty(machine):
    out = scores(machine, ["the on her and", "", None, " .!? ", "the " * 100_000, "x" * 200_000])
    assert (out < toxicity.THRESHOLD).all() and (out >= 0).all()


def test_weights_are_the_landmark_kernel():
    """The folded weights give what the sum over subsequences of both words gives."""
    spelled = [b"moron", b"mroon", b"the", b"a"]
    body, ends = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([len(w) for w in spelled])
    rows, _ = toxicity.letters(body, np.concatenate([[0], ends[:-1]]), ends)
    base = toxicity.features(rows)

    def kernel(a, b):
        def occur(w):
            letters = [toxicity.START, *(w - 96 for w in w), toxicity.END]
            out = {}
            for i in range(len(letters)):
                for j in range(i + 1, len(letters)):
                    for k in range(j + 1, min(len(letters), i + toxicity.SPAN)):
                        key = (letters[i], letters[j], letters[k])
                        out.setdefault(key, []).append(toxicity.DECAY ** (k - i + 1))
            return out

        x, y = occur(a), occur(b)
        scale = [toxicity.SOFT + sum(v * v for w in o.values() for v in w) for o in (x, y)]
        return sum(sum(x[s]) * sum(y[s]) for s in x if s in y) / np.sqrt(scale[0] * scale[1])

    for i, a in enumerate(spelled):
        for j, b in enumerate(spelled):
            assert base[i] @ base[j] == pytest.approx(kernel(a, b), rel=1e-4, abs=1e-6)


def test_query_on_tables(spark, sf_dir, odd, nothing):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = toxicity.learn(docs, labels)
    out = toxicity.score(docs, machine).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted for r in out if r.toxic == 1]) > 0.6
    assert np.mean([r.predicted for r in out if r.toxic == 0]) < 0.1
    odd_scores = toxicity.score(odd, machine).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd_scores)
    kept = toxicity.without_toxic(odd, machine)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.predicted == 0 for r in odd_scores)
    assert toxicity.score(nothing, machine).count() == 0


def test_nothing_to_learn(odd, nothing, spark, sf_dir):
    none = table(spark, sf_dir, "labels").filter(F.lit(False))
    machine = toxicity.learn(odd, none)
    assert {r.predicted for r in toxicity.score(odd, machine).collect()} == {0}


def test_contradictory_labels_and_texts_have_an_order(spark):
    """The same machine however rows lie: toxic wins, the first text counts."""
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(3, 200))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zz zz"), (4, "zz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1 - rows[0][2]), (4, 0), (8, 0)], "doc_id long, toxic int")
    one = toxicity.learn(docs, labels)
    two = toxicity.learn(docs.orderBy(F.desc("text")), labels.orderBy(F.desc("toxic")).repartition(3))
    texts = [t for _, t, _ in rows]
    assert np.array_equal(scores(one, texts), scores(two, texts))

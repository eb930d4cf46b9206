import itertools
import random
import zlib

import numpy as np

from almanac.llm import toxicity

SCHEMA = "doc_id long, text string, toxicity string, lang string"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 6, 2, 6])
    emission, moves = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    got, expected = toxicity.marginals(emission, lengths, moves, True)
    total, at = np.zeros((2, 2)), 0
    for n in lengths:
        paths, z, p = itertools.product((0, 1), repeat=int(n)), 0.0, np.zeros(n)
        moved = np.zeros((2, 2))
        for path in paths:
            w = np.exp(sum(moves[a, b] for a, b in zip((0, *path), path)) + sum(emission[at + i] for i, s in enumerate(path) if s))
            z += w
            p += w * np.array(path)
            for a, b in zip((0, *path), path):
                moved[a, b] += w
        assert np.allclose(got[at : at + n], p / z)
        total += moved / z
        at += n
    assert np.allclose(expected, total)


def corpus(n=800, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorgon", "zorgonik!", "vrakk", "vrakkest"]))
        rows.append((i, " ".join(words), "clash", "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    tagged, name = toxicity.tag(docs, model)
    assert name == "toxicity_"
    truth = dict(labels)
    held = [r for r in tagged.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100
    for r in held:
        assert 0 <= r[name].score <= 1 and r[name].predicted == truth[r.doc_id], r.text
        marked = [r.text[s.start : s.end].lower() for s in r[name].spans]
        assert all("zorgon" in m or "vrakk" in m for m in marked) and bool(marked) == bool(truth[r.doc_id])
    assert sorted(r.doc_id for r in toxicity.toxicity_filter(docs, marks).collect()) == [i for i, t in labels if not t]


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and (a.scale == b.scale).all()


def test_odd_rows(spark):
    rows, labels = corpus(300)
    odd = [(9000, None, "c", None), (9001, "", "c", None), (9002, "!!! \n", "c", None), (9003, "zorgon " * 30_000, "c", None), (None, "x vrakk İ zorgon", "c", None), (5, rows[5][1], "c", None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame(labels + [(3, None), (None, 1), (8, 1), (8, 0), (777777, 1)], "doc_id long, toxic int")
    tagged, name = toxicity.tag(docs, toxicity.learn(docs, marks))
    got = {(r.doc_id, r.text): r[name] for r in tagged.collect()}
    assert tagged.count() == 306
    assert got[9000, None].score == got[9001, ""].score == got[9002, "!!! \n"].score < 0.5
    assert got[9003, "zorgon " * 30_000].predicted == 1 and got[None, "x vrakk İ zorgon"].predicted == 1
    assert toxicity.tag(docs.limit(0), toxicity.learn(docs, marks))[0].count() == 0


def test_without_labels(spark):
    rows, labels = corpus(50)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks in (none, spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")):
        tagged, name = toxicity.tag(docs, toxicity.learn(docs, marks))
        assert {r[name].predicted for r in tagged.collect()} == {0}


def test_long_clean_texts_are_clean(spark):
    """Length alone must not make a text toxic, and one insult in a long text must."""
    rows, labels = corpus(1000)
    rng = random.Random(2)
    model = toxicity.train([r[1] for r in rows], [t for _, t in labels], (800, 200))
    assert np.abs(model.scale).max() < 50
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)) for n in (10, 100, 1000, 10_000)]
    scorer = toxicity.Scorer(model)
    assert (scorer.score(clean)[0] < 0.5).all()
    assert (scorer.score([t + " zorgon" for t in clean])[0] >= 0.5).all()

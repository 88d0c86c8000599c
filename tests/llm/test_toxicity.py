import random

import pytest

from tidemark.llm import toxicity as T

from .conftest import prose


def ruzzo_tompa(scores):
    """All maximal scoring segments by definition: split at the best one, again and again."""

    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                # of equal sums the shortest counts: no part of it that ends or begins may sum to nothing
                if s > 0 and (top is None or s > top[0] + 1e-12):
                    top = (s, i, j + 1)
        if top is None:
            return []
        _, i, j = top
        return best(a, i) + [top] + best(j, b)

    return best(0, len(scores))


def test_segments_are_maximal():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    weight = {w: rng.choice([0.37, 1.21, 2.93]) for w in words[:9]}
    m = T.Model(weight, drift=0.5)
    for _ in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        n, got = m.segments(" ".join(text))
        want = ruzzo_tompa([weight.get(w, -0.5) for w in text])
        starts = {}
        at = 0
        for k, w in enumerate(text):
            starts[at] = k
            at += len(w) + 1
        assert n == len(text)
        assert sorted((round(s, 6), starts[a]) for s, a, _ in got) == sorted((round(s, 6), i) for s, i, _ in want)


def corpus(spark, n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, rng.randint(8, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zzvile", "zzvilest", "qqcrude"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(spark)
    return docs, T.train(docs, labels.where(~T.held_out()))


def test_held_out_accuracy(trained):
    docs, model = trained
    got = {r.id: r.score for r in T.score(docs, model).collect()}
    assert len(got) == 900 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.5) == (i % 6 == 0) for i in got)
    assert right >= 0.97 * len(got)
    low = min(s for i, s in got.items() if i % 6 == 0)
    assert sum(s > low for i, s in got.items() if i % 6) <= 0.03 * len(got)


def test_awkward(trained, awkward):
    _, model = trained
    got = T.score(awkward, model).collect()
    assert len(got) == awkward.count()
    assert all(r.score < 0.5 for r in got)
    left = T.drop_toxic(awkward, model)
    assert left.columns == awkward.columns and left.count() == awkward.count()


def test_passages(spark, trained):
    _, model = trained
    text = prose(5000, 40) + " ZZVILE qqcrude " + prose(5001, 40)
    df = spark.createDataFrame([(1, text), (2, prose(5002, 50)), (3, None)], "doc_id long, text string")
    rows = T.passages(df, model).collect()
    assert [r.id for r in rows] == [1] and "zzvile" in rows[0].passage
    assert text.lower()[rows[0].start : rows[0].end] == rows[0].passage


def test_nothing_to_learn(spark, nothing, awkward):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    for docs in (nothing, awkward):
        model = T.train(docs, labels)
        assert all(r.score < 0.5 for r in T.score(docs, model).collect())
    assert T.score(nothing, T.Model()).count() == 0


def test_bounded_sample_of_labels(spark):
    docs, labels = corpus(spark)
    model = T.train(docs, labels, max_labels=200)
    assert model.weight
    got = {r.id: r.score >= 0.5 for r in T.score(docs, model).collect()}
    assert sum(got[i] == (i % 6 == 0) for i in got) >= 0.9 * len(got)


def test_whole_table_against_brute_force(trained):
    """Every score from segments that are found by definition and the law of Karlin and Altschul."""
    import math

    docs, model = trained
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.score(docs, model).collect():
        words = T.WORD.findall(texts[r.id].lower())
        sums = [model.lam * s for s, _, _ in ruzzo_tompa([model.word_score(w) for w in words])]
        base = math.log(model.k * len(words))
        x = max(sums, default=0.0) - base + math.log(max(1, sum(v > base for v in sums)))
        assert abs(r.score - 1 / (1 + math.exp(-model.slope * (x - model.cut)))) < 1e-6


def test_long_text_takes_linear_time():
    import time

    model = T.Model({"bad": 0.3}, drift=0.5)
    began = time.perf_counter()
    n, found = model.segments("bad good " * 200_000)
    assert n == 400_000 and len(found) == 200_000 and time.perf_counter() - began < 10

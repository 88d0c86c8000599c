import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as S

from .conftest import awkward_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Windows keyed by their words; the earliest (id, start) keeps its words."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(df, rows, window=20):
    got = S.remove_repeats(df, window=window).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


@pytest.mark.parametrize("window", [6, 20])
def test_awkward(awkward, window):
    check(awkward, [(r[0], r[1]) for r in awkward_rows()], window)


def test_empty(nothing):
    assert S.remove_repeats(nothing).count() == 0


def test_shared_passages_at_every_offset(spark, monkeypatch):
    rng = random.Random(6)
    passage = prose(50, 45).split()
    rows = []
    for i in range(400):
        w = prose(1000 + i, rng.randint(0, 60)).split()
        if i % 3 == 0:
            a = rng.randint(0, 20)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + rng.randint(15, 45)]
        if i % 11 == 0:
            w = w + w
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "stop stop " * 30) for i in range(5)]
    monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(S, "SLICE_BYTES", 5000)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_kept_text(spark):
    p = prose(8, 25)
    df = spark.createDataFrame([(2, "new " + p + " end"), (1, p)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in S.remove_repeats(df, texts=True).collect()}
    assert got == {1: p, 2: "new end"}


def test_equal_hashes_remove_nothing(spark):
    """Windows that differ in words of equal polynomials modulo 2**64 are different windows."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    rest = prose(60, 20)
    rows = [(1, f"{rest} {x}"), (2, f"{rest} {y}"), (3, f"{x} {rest}"), (4, f"{y} {prose(61, 20)}"), (5, f"{x} {prose(61, 20)}"), (6, f"{x} {rest} {y}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    check(df, rows, 21)


def test_texts_that_share_an_id(spark):
    p, q = prose(62, 40), prose(63, 40)
    rows = [(1, p), (2, q + " " + p), (2, "other " + p + " " + q), (3, q)]
    got = S.remove_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string"), texts=True).collect()
    assert sorted(r.kept_text for r in got if r.doc_id == 1) == [p]
    assert sum(r.n_removed for r in got) >= 80

import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from tidemark.llm import packing as P

from .conftest import awkward_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity]
            want.append((i is None, i or 0, p // capacity, p, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for _, seq in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len({r.sequence_id for r in got})


@pytest.mark.parametrize("capacity", [64, 2048])
def test_awkward(awkward, capacity):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = P.pack(awkward, PATH, capacity=capacity).collect()
    used = check(rows, got, capacity)
    assert used <= 1.02 * P.lower_bound(np.array([r.length for r in got]), capacity) + 1


def test_empty(nothing):
    assert P.pack(nothing, PATH).count() == 0


def test_many_rounds(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 60)) for i in range(800)]
    monkeypatch.setattr(P, "GROUP", 60)
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacity=61).collect()
    used = check(rows, got, 61)
    one = len(P.best_fit_decreasing(np.array([r.length for r in got]), 61)[2])
    assert used <= 1.03 * one + 1


def test_best_fit_and_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cap = int(rng.integers(5, 40))
        w = rng.integers(1, cap + 1, int(rng.integers(0, 30)))
        where, offset, left = P.best_fit_decreasing(w, cap)
        for b in range(len(left)):
            assert w[where == b].sum() == cap - left[b]
            o = np.sort(offset[where == b])
            assert (len(o) == 0) or o[0] == 0
        assert P.lower_bound(w, cap) <= len(left)


def test_bound_never_exceeds_optimum():
    rng = np.random.default_rng(1)

    def optimum(w, cap):
        best = len(w)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(w):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + w[i] <= cap:
                    bins[k] += w[i]
                    place(i + 1, bins)
                    bins[k] -= w[i]
            place(i + 1, [*bins, w[i]])

        place(0, [])
        return best

    for _ in range(120):
        cap = int(rng.integers(4, 20))
        w = rng.integers(1, cap + 1, int(rng.integers(1, 8))).tolist()
        assert P.lower_bound(np.array(w), cap) <= optimum(w, cap)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), P.Encoder(PATH)
    for s in ["", "A b, C.", "don't  stop\tnow \x85x", "<|endoftext|> <|ENDOFTEXT|>, x", "ÀÉÎ. İ Σας ΣΑΣ ﬁ ²3 你好,", "é , ́a", "a\x01b", "..,. x,,y."]:
        want = np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        assert e.encode(s) == want == e.encode(s), s

import random
import re

import numpy as np
import pytest

from tidemark.llm import near_dedup as N
from tidemark.llm import words as W

from .conftest import awkward_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(df, rows, n):
    want = brute([r for r in rows if r[0] is not None], n)
    got = N.near_groups(df, n_words=n).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t, n)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("n", [2, 5])
def test_awkward(awkward, n):
    check(awkward, [(r[0], r[1]) for r in awkward_rows()], n)


def test_empty(nothing):
    assert N.near_groups(nothing).count() == 0
    assert N.drop_near_copies(nothing).count() == 0


def test_chains_and_borders(spark):
    """Edits of growing number: links in a chain, with pairs on both sides of the threshold."""
    rng = random.Random(7)
    rows = []
    for g in range(6):
        w = prose(100 + g, 60).split()
        for k in range(25):
            v = list(w)
            for _ in range(rng.randint(0, 9)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(4)}"
            rows.append((1000 * g + k, " ".join(v)))
            if k % 5 == 4:
                w = v
    rows += [(9000 + k, " ".join(["a", "b", "c", "d", "e"][: k % 5 + 1])) for k in range(10)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 2)


def test_blocks_of_a_group_meet(spark, monkeypatch):
    """With tiny blocks every pair of blocks is compared."""
    rng = random.Random(3)
    w = prose(5, 50).split()
    rows = []
    for k in range(60):
        v = list(w)
        for _ in range(rng.randint(3, 8)):
            v[rng.randrange(50)] = f"x{rng.randrange(6)}"
        rows.append((k, " ".join(v)))
    monkeypatch.setattr(N, "BLOCK", 4)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 900):
        est = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(x[: n + n // 2]), np.unique(x[n // 2 :])
            s = N.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != N.NONE).all()
            est.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(est)) < 0.03


def test_one_element_takes_each_register_once():
    s = N.signatures(np.array([12345], np.uint64), np.array([0, 1]))[0]
    assert sorted(s >> 24) == list(range(N.M))


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["a b c", None, "", "  x\ty\n", "one", "a b a b a b", "é ü"]
    for i, j, data, off in W.chunks(pa.array(texts), 4):
        eo = W.shingles(data, off, 2).off
        for k in range(i, j):
            assert eo[k - i + 1] - eo[k - i] == len(shingles(texts[k], 2))


def thue_morse():
    """Two different words that polynomials modulo 2**64 cannot tell apart."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    return x, y


def test_equal_hashes_link_nothing(spark):
    """Words, shingles, digests and links are told apart by bytes where their hashes are equal."""
    x, y = thue_morse()
    rest = prose(9, 30)
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}"), (4, f"{y} {x} {y}"), (5, f"{rest} {x} {y}"), (6, f"{rest} {y} {x}"), (7, f"{x} {rest}"), (8, f"{y} {rest}")]
    for n in (2, 5):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, n)


@pytest.mark.parametrize("n", [2, 5])
def test_colliding_hashes(spark, monkeypatch, n):
    """A hash of five bits: nearly everything collides, and results stay those of brute force."""
    real = W.word_hashes
    monkeypatch.setattr(W, "word_hashes", lambda *a: real(*a) & W.U(31))
    import pyarrow as pa

    rng = random.Random(n)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts] + texts[:9]
    sets = [shingles(t, n) for t in texts]
    data, off = W.buffers(pa.array(texts))
    made = W.shingles(data, off, n)
    assert np.diff(made.off).tolist() == [len(s) for s in sets]
    digests = made.digests(data, n)
    numbers = made.numbers(n)
    numbered = [frozenset(numbers[i:j].tolist()) for i, j in zip(made.off[:-1], made.off[1:])]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (a == b) == (digests[i] == digests[j]) and len(a & b) == len(numbered[i] & numbered[j])
    got = N.similar(pa.array(texts[:60]), pa.array(texts[60:120]), n, 80)
    want = [i for i in range(60) if sets[i] | sets[60 + i] and 100 * len(sets[i] & sets[60 + i]) >= 80 * len(sets[i] | sets[60 + i])]
    assert got.tolist() == want


def test_texts_that_share_an_id(spark):
    """Each text of a repeated id links for it, whichever row comes first."""
    base, other = prose(11, 60), prose(12, 60)
    rows = [(7, base), (7, other), (8, base + " x"), (3, other + " y"), (9, prose(13, 50)), (7, base), (None, base), (2, None), (2, other + " z")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 2)


def test_hot_group(spark):
    """Most rows are copies or near copies of one text: frequent keys are dealt over salts."""
    base = prose(21, 80).split()
    rows = [(i, " ".join([*base[: i % 7], f"w{i % 900}", *base[i % 7 :]])) for i in range(3000)]
    rows += [(10_000 + i, prose(5000 + i, 20)) for i in range(50)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2)
    assert got.where("doc_id < 10000").select("component_id").distinct().collect()[0][0] == 0
    assert got.where("kept").count() == 51

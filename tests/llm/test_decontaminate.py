import random

import pytest

from tidemark.llm import decontaminate as C

from .conftest import prose


def distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        d = distance(item, text)
        assert C.myers(item, text, 99) == d
        assert d == 0 or C.myers(item, text, d - 1) is None


def test_pieces_make_up_the_item():
    for n in range(1, 60):
        for k in range(min(n, 6)):
            parts = C.pieces("x" * n, k)
            assert len(parts) == k + 1 and "".join(p for _, p in parts) == "x" * n and all(p for _, p in parts)


def test_no_match_within_budget_is_missed():
    rng = random.Random(2)
    for _ in range(250):
        item = C.normalise("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(10, 120))))
        m = list(item)
        for _ in range(rng.randint(0, 7)):
            p = rng.randrange(len(m))
            kind = rng.random()
            if kind < 0.33:
                m[p] = rng.choice("abcdefgh ")
            elif kind < 0.66:
                m.insert(p, rng.choice("abcdefgh"))
            elif len(m) > 1:
                del m[p]
        noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(40))
        text = C.normalise(noise() + " " + "".join(m) + " " + noise())
        k = int(C.RATE * len(item))
        d = distance(item, text) if k else distance(f" {item} ", f" {text} ")
        assert C.Matcher([(1, item)], C.RATE).match(text).get(1) == (d if d <= k else None)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(900, 20)), (2, prose(901, 25)), (3, prose(1, 30_000)[:200]), (4, None), (5, ""), (None, "abc"), (6, "..!")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_awkward(awkward, bench):
    _, items = bench
    got = C.contamination(awkward, items).collect()
    assert len(got) == awkward.count()
    assert sorted(r.doc_id for r in got if r.contaminated) == [11, 12]
    assert all(r.item_ids == [3] and r.n_items == 1 and r.least_edits == 0 for r in got if r.contaminated)
    left = C.drop_contaminated(awkward, items)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 2


def test_edited_passages_and_blocks(spark, bench, monkeypatch):
    rows, items = bench
    a, b = rows[0][1], rows[1][1]
    docs = [
        (1, f"before {a.upper()} after"), (2, a.replace(" ", ",  ", 4)), (3, a[:30] + "zz" + a[32:] + " " + b), (4, a[: len(a) // 2]),
        (5, prose(77, 200)), (5, prose(77, 200)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, [1], 0), (2, [1], 0), (3, [1, 2], 0), (4, [], None), (5, [], None), (5, [], None)]
    for most in (10**6, 50):
        monkeypatch.setattr(C, "BLOCK_CHARS", most)
        monkeypatch.setattr(C.item_blocks, "__defaults__", (most,))
        got = sorted((r.doc_id, list(r.item_ids), r.least_edits) for r in C.contamination(df, items).collect())
        assert got == want
        assert sorted(r.doc_id for r in C.drop_contaminated(df, items).collect()) == [4, 5, 5]


def test_empty(nothing, awkward, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.contamination(nothing, none).count() == 0
    assert not any(r.contaminated for r in C.contamination(awkward, none).collect())
    assert C.drop_contaminated(awkward, none).count() == awkward.count()


def test_short_items_are_whole_words():
    m = C.Matcher([(1, "cat"), (2, "a cat sat")], C.RATE)
    assert m.match(C.normalise("We concatenate lists; a cat, sat.")) == {1: 0, 2: 0}
    assert m.match(C.normalise("We concatenate lists")) == m.match("") == {}
    assert m.match("cat") == {1: 0}


def test_items_that_share_pieces():
    """Many items of one beginning: each is found where it is, by brute force."""
    rng = random.Random(4)
    head = prose(70, 20)
    items = [(i, C.normalise(f"{head} {prose(300 + i, 18)}")) for i in range(30)]
    texts = [C.normalise(f"{prose(600 + i, 30)} {t[: len(t) - rng.randint(0, 16)]} {prose(700 + i, 9)}") for i, t in items[:12]]
    m = C.Matcher(items, C.RATE)
    for t in texts:
        want = {}
        for i, item in items:
            d = distance(item, t)
            if d <= int(C.RATE * len(item)):
                want[i] = d
        assert m.match(t) == want


def test_whole_table_against_brute_force(spark):
    rng = random.Random(14)
    items = [(i, prose(800 + i, rng.randint(1, 30))) for i in range(12)]
    rows = []
    for i in range(60):
        w = prose(2000 + i, 40).split()
        if i % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 8)):
                part[rng.randrange(len(part))] = rng.choice("xyz")
            w[10:10] = ["".join(part)]
        rows.append((i, " ".join(w)))
    got = C.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        text = f" {C.normalise(rows[r.doc_id][1])} "
        long = lambda t: int(C.RATE * len(C.normalise(t))) > 0
        near = {i: distance(C.normalise(t) if long(t) else f" {C.normalise(t)} ", text) for i, t in items}
        want = {i: d for i, d in near.items() if d <= int(C.RATE * len(C.normalise(items[i][1])))}
        assert (r.item_ids, r.least_edits, r.contaminated) == (sorted(want), min(want.values(), default=None), bool(want))

import hashlib
from collections import defaultdict

from tidemark.llm.exact_dedup import ascii_lower, drop_exact_copies, exact_groups
from pyspark.sql import functions as F

from .conftest import awkward_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOW)].append(i)
    return groups


def check(df, rows, **kw):
    groups = expected(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    got = exact_groups(df, **kw).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = by_sha[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(real) if real else None)
    for sha, ids in by_sha.items():
        kept = [r.doc_id for r in got if r.text_sha256 == sha and r.kept]
        real = [i for i in ids if i is not None]
        assert kept == [max(real) if real else None]


def test_awkward(awkward):
    check(awkward, awkward_rows())


def test_small_blocks_make_many_levels(awkward):
    check(awkward, awkward_rows(), block_chars=7)


def test_empty(nothing):
    assert exact_groups(nothing).count() == 0
    assert drop_exact_copies(nothing).count() == 0


def test_hot_group_and_prefixes(spark):
    texts = ["same text " * 50] * 300 + ["same text " * 50 + "x"] * 3 + ["same text " * k for k in range(1, 60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, block_chars=64)


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ÀÉÎ AbC", "Straße İ Σ", "ΑΣ Z", "plain Z", "", "K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()]
    assert got == [t.translate(LOW) for t in texts]


def test_drop_keeps_columns_and_rows_without_id(awkward):
    left = drop_exact_copies(awkward)
    assert left.columns == awkward.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    # null, empty and blank texts: 5 and 6 are equal, 6 stays
    assert ids == [3, 3, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16]


def test_drop_decides_by_row(spark):
    rows = [(1, "copied text"), (1, "only here"), (2, "Copied text"), (3, "twice"), (3, "twice"), (3, "Twice"), (None, "twice"), (4, "alone")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _sha string").repartition(3)
    key = lambda r: (r[0] or 0, r[1].lower())
    got = [(r.doc_id, r.text) for r in drop_exact_copies(docs, one_of_repeated=True).collect()]
    assert sorted(map(key, got)) == [(0, "twice"), (1, "only here"), (2, "copied text"), (3, "twice"), (4, "alone")]
    assert sorted(r.doc_id or 0 for r in drop_exact_copies(docs).collect()) == [0, 1, 2, 3, 3, 3, 4]


def test_names_are_the_same_under_any_layout(spark):
    """Names are ranks of the distinct blocks, whatever the files and partitions are, also of blocks that are frequent."""
    from tidemark.llm.exact_dedup import name_contents
    from tidemark.llm.scratch import Scratch

    texts = ["hot"] * 200 + [f"t{i % 70}" for i in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    seen = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "rid long, block string").repartition(parts)
        got = name_contents(df, ["block"], Scratch(spark, "names"), "block", len(rows)).collect()
        assert len(got) == len(rows)
        seen.append({texts[r.rid]: r.name for r in got})
        assert sorted(set(r.name for r in got)) == list(range(71)) and len({(texts[r.rid], r.name) for r in got}) == 71
    assert seen[0] == seen[1]


def test_blocks_of_one_hash_are_told_apart(spark, monkeypatch):
    from tidemark.llm import exact_dedup as E

    real = F.xxhash64
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: real(*c) % 3)
    rows = [(i, f"text {i % 9}" * (1 + i % 4)) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, block_chars=9)

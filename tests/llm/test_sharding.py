import zlib

from tidemark.llm.sharding import _plan, shard_rows

from .conftest import awkward_rows, prose


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return {s: sum(r["size"] for r in rs) for s, rs in by.items()}


def test_awkward(awkward):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check(rows, shard_rows(awkward).collect(), 16)


def test_empty(nothing):
    assert shard_rows(nothing).count() == 0


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(3000)] + [(10_000 + i, "copy " * 30) for i in range(60)]
    rows += [(20_000 + i, "other " * 9) for i in range(40)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check(rows, got, 16)
    assert len(sizes) == 16 and max(sizes.values()) < 1.03 * min(sizes.values())
    for low in (10_000, 20_000):
        assert len({r.shard for r in got if low <= r.doc_id < low + 9000}) == 1


def test_overfull_text_is_subdivided(spark):
    rows = [(i, prose(i, 20)) for i in range(1000)] + [(10_000 + i, "hot " * 30) for i in range(1000)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check(rows, got, 16)
    assert len(sizes) == 16 and max(sizes.values()) < 1.03 * min(sizes.values())
    assert len({r.shard for r in got if r.doc_id >= 10_000}) > 5


def test_plan_fills_every_shard():
    pieces, before = _plan([(-1, 0, 60), (-1, 1, 40), (0, 0, 100)], [(0, 100)], 4, 200)
    assert sum(len(p) for p in pieces.values()) >= 4
    assert before == {(-1, 0): 0, (-1, 1): 60, (0, 0): 0}

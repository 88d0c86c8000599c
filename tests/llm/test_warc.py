import gzip
import hashlib
import io
import json
import random

import pytest
from pyarrow import fs as pafs

from tidemark.llm import warc as A


def sample(n=40):
    rng = random.Random(1)
    return [A.page_record(i, f"http://h/{i}\r\nX: y", rng.randbytes(rng.randint(0, 400)), "d%d" % i, i - 1 if i % 5 == 4 else None) for i in range(n)]


def test_normaliser_keeps_every_record():
    raw = b"".join(sample())
    for stream in (gzip.compress(raw), gzip.compress(raw[:5000]) + gzip.compress(raw[5000:])):
        out, index = io.BytesIO(), io.BytesIO()
        assert A.normalise(io.BytesIO(stream), out, index) == 40
        assert gzip.decompress(out.getvalue()) == raw
        entries = [json.loads(x) for x in index.getvalue().splitlines()]
        at = 0
        for e, want in zip(entries, sample(), strict=True):
            assert e["offset"] == at
            member = out.getvalue()[at : at + e["length"]]
            assert gzip.decompress(member) == want
            at += e["length"]
        assert at == len(out.getvalue())


def test_headers_cannot_be_broken():
    (headers, block, _), = [(h, b"".join(b), x) for h, b, x in A.records(io.BytesIO(gzip.compress(sample(1)[0])))]
    assert headers["warc-target-uri"] == "http://h/0%0D%0AX: y" and "x" not in headers


def test_damage_is_noticed(tmp_path):
    files = pafs.LocalFileSystem()
    with pytest.raises(ValueError):
        list(A.records(io.BytesIO(gzip.compress(b"no record\r\n\r\n"))))
    with pytest.raises(ValueError):
        for _, block, _ in A.records(io.BytesIO(gzip.compress(sample(1)[0][:-60]))):
            b"".join(block)
    A.write_monolithic(str(tmp_path / "a.gz"), iter(sample()), files)
    A.normalise_file(files, str(tmp_path / "a.gz"), str(tmp_path / "b.warc.gz"))
    assert len(list(A.read_records(files, str(tmp_path / "b.warc.gz")))) == 40


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i is None, i or 0, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to is None, to or 0))
    return sorted(out)


def check(df, rows):
    got = A.round_trip(df).collect()
    key = lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to is None, r.refers_to or 0)
    assert sorted(map(key, got)) == brute(rows)


def test_round_trip(spark):
    big = "<p>é&amp;</p>" * 30
    rows = [(i, f"http://x/{i}", big if i % 3 else "short") for i in range(30)]
    rows += [(100, None, None), (101, "", ""), (102, "u", "x" * 99), (103, "u", "x" * 99), (104, "u", "y" * 100), (105, "u", "y" * 100)]
    rows += [(7, "again", big), (1, "first again", big), (None, "n", big), (None, None, "z" * 200), (None, None, "z" * 200), (200, "u", "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    check(df.selectExpr("*", "1 as sha", "2 as first", "3 as path"), rows)


def test_empty(spark):
    assert A.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

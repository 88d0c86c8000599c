"""Removal of repeated passages by fixed-block anchors.

A window of ``window`` words that occurs twice holds, where it occurs first, one
whole block of ``window // 2`` words that starts at a multiple of that length.
So only non-overlapping reference blocks are indexed, and every rolling block of
every text probes the index by a hash. Around each hit all windows that hold it
are compared by the BLAKE2b name of their words, 128 bits, so that a collision of
hashes never removes anything; those that start earlier elsewhere are removed,
and adjacent ones make up the maximal repeat.

Scale. Probes, hits and windows travel as packed arrays, dealt over slices of
the hash space and buckets of texts whose numbers follow the bytes of the input,
so that what one task holds does not grow with it. Each batch first
settles its own repeats and sends one entry for each distinct hash, so a passage
in a third of all texts is one entry per batch and not one per text; answers go
back by buckets of document ids. Nothing is collected, broadcast or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .kept import forget
from .scratch import Scratch

U = np.uint64
WINDOW = 20
SLICE_BYTES = 4 << 20  # of text whose entries make up a slice; an entry is 8 bytes for a word
BUCKET_BYTES = 800_000  # of texts that are worked on at once
BATCH_BYTES = 2 << 20
BATCH_ROWS = 16_000


def _window_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(windows, 2) uint64: BLAKE2b names of 128 bits of the words of the windows that begin at ``at``.

    Words hold no space, so words joined by one space name their sequence.
    """
    if not len(at):
        return np.zeros((0, 2), U)
    length = end - start + 1
    first = np.concatenate([[0], np.cumsum(length)])
    own = np.arange(first[-1]) + np.repeat(start - first[:-1], length)
    joined = data[np.minimum(own, len(data) - 1)]
    joined[first[1:] - 1] = 32
    raw = joined.tobytes()
    spans = zip(first[at].tolist(), first[at + window].tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in spans]), U).reshape(len(at), 2)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places that have it) for each distinct key."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            yield int(keys[part[0]]), part


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH_ROWS):
            part = b.slice(i, BATCH_ROWS)
            for j, k, data, off in W.chunks(part.column(text), BATCH_BYTES):
                yield part.slice(j, k - j), data, off


PROBES = "slice int, keys binary, places binary"
HITS = "bucket int, keys binary"
BLOCK, MANY = 2, 1  # an entry is a block of its text; it stands for several places, whose batch knows them


def _probe(window: int, bits: int):
    """(id, bucket, text) -> entries of each slice; slices from 2**bits on carry hits that the batch found itself.

    An entry is a key and the bucket of a text that has it, so its size does not depend on the number of slices.
    """
    n, slices = window // 2, 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        turn = 0
        for b, data, off in _batches(batches, 2):
            buckets = b.column(1).to_numpy().astype(np.uint32)
            start, end, first = W.spans(data, off)
            g = W.gram_hashes(W.word_hashes(data, start, end), n)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(first))[: len(g)]
            at = np.flatnonzero(np.arange(len(g)) + n <= first[1:][doc])
            # 32 bits besides those that name the slice
            key = g[at] >> U(32 - bits)
            aligned = (at - first[doc[at]]) % n == 0
            order = np.argsort(key, kind="stable")
            key, bucket, aligned = key[order], buckets[doc[at]][order], aligned[order]
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(new, len(key)))
            block = np.logical_or.reduceat(aligned, new)
            one = key[new]
            packed = (bucket[new] << np.uint32(2)) | np.where(block, BLOCK, 0).astype(np.uint32) | np.where(count > 1, MANY, 0).astype(np.uint32)
            low, where = one.astype(np.uint32), (one >> U(32)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rows: tuple[list, list, list] = ([], [], [])
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(one)], strict=True):
                for r, x in zip(rows, (int(where[i]), low[i:j].tobytes(), packed[i:j].tobytes()), strict=True):
                    r.append(x)
            many = np.repeat(count > 1, count)
            if many.any():
                hit, owner = key[many], bucket[many]
                for k, part in _by(owner):
                    turn += 1
                    for r, x in zip(rows, (slices + (k * 31 + turn) % slices, np.unique(hit[part]).tobytes(), np.array([k], np.uint32).tobytes()), strict=True):
                        r.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["slice", "keys", "places"])

    return run


def _meet(bits: int):
    """All entries of a slice -> hits by bucket: blocks that another text or place has too."""
    slices = 1 << bits

    def answer(rows: list[tuple[int, np.ndarray]]) -> pa.Table:
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1].tobytes() for r in rows], pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        s = table.column("slice")[0].as_py()
        if s >= slices:
            cols = [table.column(c).to_pylist() for c in ("places", "keys")]
            return answer([(int(np.frombuffer(b, np.uint32)[0]), np.frombuffer(k, U)) for b, k in zip(*cols, strict=True)])
        key, pack = _joined(table, "keys", np.uint32), _joined(table, "places", np.uint32)
        order = np.argsort(key, kind="stable")
        key, pack = key[order], pack[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(new, len(key)))
        block = np.logical_or.reduceat((pack & BLOCK) > 0, new)
        many = np.logical_or.reduceat((pack & MANY) > 0, new)
        hit = np.repeat(block & ((count > 1) | many), count)
        # entries that stand for several places were answered by their own batch
        sent = np.flatnonzero(hit & ((pack & MANY) == 0))
        own = key[sent].astype(U) | (U(s) << U(32))
        return answer([(b, own[p]) for b, p in _by(pack[sent] >> np.uint32(2))])

    return run


REQUESTS = "slice int, bucket int, ids binary, hashes binary, places binary, starts binary"
FLAGS = "bucket int, ids binary, starts binary, checks binary"


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _candidates(window: int, bits: int):
    """A bucket's texts and hits -> the windows around hits, one for each distinct word sequence."""
    n, slices = window // 2, 1 << bits

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows = [[], [], [], [], [], []]

        def done() -> pa.Table:
            return pa.table(
                [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[2:]]],
                names=["slice", "bucket", "ids", "hashes", "places", "starts"],
            )

        if not docs.num_rows or not hits.num_rows:
            return done()
        bucket = docs.column("bucket")[0].as_py()
        ids = docs.column("id").to_numpy()
        # a block that another text of the bucket shares is a hit here too
        found = _joined(hits, "keys", U)
        data, off = W.buffers(docs.column("text"))
        start, end, first = W.spans(data, off)
        g = W.gram_hashes(W.word_hashes(data, start, end), n)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        ok = np.arange(len(g)) + n <= first[1:][doc[: len(g)]]
        hit = ok & np.isin(g >> U(32 - bits), found)
        total = np.concatenate([[0], np.cumsum(hit)])
        at = np.arange(max(0, len(start) - window + 1))
        inside = at + window <= first[1:][doc[: len(at)]]
        at = at[inside & (total[at + window - n + 1] > total[at])]
        owner, seq = doc[at], _window_names(data, start, end, at, window)
        pos = (at - first[owner]).astype(np.int32)
        order = np.lexsort((pos, ids[owner], seq[:, 1], seq[:, 0]))
        seq, owner, pos = seq[order], owner[order], pos[order]
        new = np.concatenate([[True], (seq[1:] != seq[:-1]).any(axis=1)]) if len(seq) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
        later = (ids[owner] != ids[owner[lead]]) | (pos != pos[lead]) if len(seq) else new

        def add(s: int, part: np.ndarray, who: np.ndarray, places: np.ndarray) -> None:
            for r, x in zip(rows, (s, bucket, who.tobytes(), seq[part].tobytes(), places.tobytes(), pos[part].tobytes()), strict=True):
                r.append(x)

        part = np.flatnonzero(later)
        if len(part):
            add(slices + bucket % slices, part, ids[owner[part]], np.zeros(0))
        heads = np.flatnonzero(new)
        if not len(heads):
            return done()
        for s, p in _by((seq[heads, 0] >> U(64 - bits)).astype(np.int64)):
            who, places = np.unique(owner[heads[p]], return_inverse=True)
            add(s, heads[p], ids[who], places.astype(np.uint32))
        return done()

    return run


def _first(bits: int):
    """All windows of a slice -> flags, by bucket, of those whose word sequence starts earlier."""
    slices = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        s = table.column("slice")[0].as_py()
        bucket = table.column("bucket").to_pylist()
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        hashes = [np.frombuffer(x, U).reshape(-1, 2) for x in table.column("hashes").to_pylist()]
        starts = [np.frombuffer(x, np.int32) for x in table.column("starts").to_pylist()]
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if s >= slices:
            out = list(zip(bucket, ids, starts, hashes, strict=True))
        else:
            places = [np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()]
            who = np.concatenate([i[p] for i, p in zip(ids, places, strict=True)])
            seq, pos = np.concatenate(hashes), np.concatenate(starts)
            home = np.repeat(np.array(bucket, np.int32), [len(x) for x in hashes])
            order = np.lexsort((pos, who, seq[:, 1], seq[:, 0]))
            q = seq[order]
            new = np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))]
            late = order[(who[order] != who[lead]) | (pos[order] != pos[lead])]
            out = [(b, who[late[p]], pos[late[p]], seq[late[p]]) for b, p in _by(home[late])]
        return pa.table(
            {
                "bucket": pa.array([x[0] for x in out], pa.int32()),
                "ids": pa.array([x[1].tobytes() for x in out], pa.binary()),
                "starts": pa.array([x[2].tobytes() for x in out], pa.binary()),
                "checks": pa.array([x[3][:, 1].tobytes() for x in out], pa.binary()),
            }
        )

    return run


RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(window: int, texts: bool):
    """A bucket's texts and flags -> what is left of each text."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        n = docs.num_rows
        ids = docs.column("id").to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
        data, off = W.buffers(docs.column("text"))
        start, end, first = W.spans(data, off)
        gone = np.zeros(len(start) + 1, np.int64)
        if flags.num_rows and len(start):
            fid, pos, check = _joined(flags, "ids", np.int64), _joined(flags, "starts", np.int32), _joined(flags, "checks", U)
            order = np.argsort(fid, kind="stable")
            fid, pos, check = fid[order], pos[order], check[order]
            lo, hi = np.searchsorted(fid, ids, "left"), np.searchsorted(fid, ids, "right")
            _, number, rows = np.unique(ids, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(hi > lo):
                p, c = pos[lo[k] : hi[k]] + first[k], check[lo[k] : hi[k]]
                own = p + window <= first[k + 1]
                p, c = p[own], c[own]
                if rows[number[k]] > 1:
                    # rows that share an id without sharing the text keep what is not theirs
                    p = p[_window_names(data, start, end, p, window)[:, 1] == c]
                np.add.at(gone, p, 1)
                np.add.at(gone, p + window, -1)
        keep = np.cumsum(gone[:-1]) == 0
        raw = data.tobytes()
        count, removed, sha, left = np.diff(first), [], [], []
        for k in range(n):
            a, b = first[k], first[k + 1]
            own = np.flatnonzero(keep[a:b]) + a
            text = b" ".join([raw[x:y] for x, y in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            removed.append(int(b - a - len(own)))
            sha.append(hashlib.sha256(text).hexdigest())
            left.append(text.decode() if texts else None)
        return pa.table(
            {
                "id": docs.column("id").cast(pa.int64()),
                "n_words": pa.array(count, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "kept_text": pa.array(left, pa.string()),
            }
        )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, if ``texts``, kept_text.

    Words are removed that a window covers whose word sequence also starts in a
    text of smaller id or earlier in the same text; words are compared as they
    are. Null and empty texts have no words. Rows that repeat an id and text are
    the same text and get the same result; a row without an id neither loses
    words nor takes any from others. Extra columns of any name are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, buckets = (size // SLICE_BYTES).bit_length(), size // BUCKET_BYTES + 1
    known = rows.where("id is not null").select(
        "id", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "text"
    )
    hits = scratch.save(
        known.mapInArrow(_probe(window, bits), PROBES).groupBy("slice").applyInArrow(_meet(bits), HITS), "hits"
    )
    scratch.release()
    asked = known.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_candidates(window, bits), REQUESTS)
    flags = scratch.save(asked.groupBy("slice").applyInArrow(_first(bits), FLAGS), "flags")
    scratch.release()
    out = known.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_cut(window, texts), RESULT)
    loose = rows.where("id is null").mapInArrow(_uncut(window, texts), RESULT)
    out = out.unionByName(loose).withColumnRenamed("id", id_col)
    return scratch.finish(out if texts else out.drop("kept_text"))


def _uncut(window: int, texts: bool):
    cut = _cut(window, texts)
    none = pa.table({"ids": pa.array([], pa.binary()), "starts": pa.array([], pa.binary()), "checks": pa.array([], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from cut(pa.Table.from_batches([b]), none).combine_chunks().to_batches()

    return run

"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences of their own. The rest are dealt into partitions of bounded size and
packed there by best-fit decreasing; dual feasible functions (Fekete and
Schepers 2001) bound from below how many sequences a partition needs at least.
A partition that meets its bound is certified and releases only its emptiest
sequence; one with a gap releases every sequence that is not full. What is
released is mixed anew into larger partitions and packed again, as long as that
saves sequences or until the whole table meets the bound of its histogram of
lengths.

Scale. Token ids never leave the task that makes them: only (row, piece,
length) is shuffled. A partition holds at most ``GROUP * GROWTH ** (ROUNDS - 1)``
rows of a few bytes whatever the input, and the histogram has ``capacity`` rows.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import keep
from .scratch import Scratch

CAPACITY = 2048
GROUP = 4096
GROWTH = 4
ROUNDS = 4
CACHE = 800_000


def latin1(text: str) -> bool:
    """Whether all characters are below U+0100: such texts are in composed form and lowered letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words(dict):
    """Word to ids, learnt on first sight; beyond ``CACHE`` entries new words are encoded each time.

    The tokenizer parts runs of letters from punctuation, so a word of Latin-1
    letters and one last comma or full stop has the ids of both.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__({"": b""})
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        body = word[:-1]
        if word[-1] in ",." and body.isalpha() and latin1(body):
            ids = self[body] + self[word[-1]]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHE:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins over it, so a text's ids
    are the ids of the parts between its spaces and line feeds. It lowers all
    letters, so lowering plain texts first changes nothing but saves entries;
    texts that may hold the strings of special tokens are left as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path))

    def encode(self, text: str | None) -> bytes:
        text = (text or "").replace("\n", " ")
        if "<|" not in text and latin1(text):
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split(" ")))


def _pieces(tokenizer: str, capacity: int):
    names = ["rid", "id", "piece", "start", "length", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the cache of words outlives the task
        enc = keep(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for b in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size.astype(np.int64))
            i, n = 0, b.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
                at, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(b.column(2).slice(i, j - i).to_pylist()):
                    ids = enc.encode(text) + b"\0\0\0\0"
                    step = 4 * capacity
                    for p, s in enumerate(range(0, len(ids), step)):
                        part = ids[s : s + step]
                        at.append(i + k)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(where),
                        b.column(1).take(where),
                        pa.array(piece, pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    ],
                    names,
                )
                i = j

    return run


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Least number of bins by dual feasible functions: threshold and rounding functions, and the plain sum."""
    w = np.asarray(lengths, np.int64)
    c = np.ones(len(w), np.int64) if counts is None else np.asarray(counts, np.int64)
    if not len(w):
        return 0
    best = -(-int((w * c).sum()) // capacity)
    for cut in sorted({int(x) for x in w if 2 * x <= capacity}):
        # what is over capacity - cut counts whole, what is under cut not at all
        f = np.where(w > capacity - cut, capacity, np.where(w < cut, 0, w))
        best = max(best, -(-int((f * c).sum()) // capacity))
    for k in range(1, 21):
        exact = (k + 1) * w % capacity == 0
        f = np.where(exact, w * k, (k + 1) * w // capacity * capacity)  # in units of capacity * k
        best = max(best, -(-int((f * c).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, what is left in each bin).

    Open bins stand in stacks by what is left in them; a bit mask of the
    non-empty stacks gives the best fit without a search.
    """
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[i])
        fit = mask >> w
        if fit:
            room = w + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        where[i], offset[i] = b, capacity - room
        room -= w
        left[b] = room
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    return where, offset, np.array(left, np.int64)


def _pack(capacity: int, round_: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("piece", "ascending")])
        w = table.column("length").to_numpy()
        where, offset, left = best_fit_decreasing(w, capacity)
        if len(left) == lower_bound(w, capacity):
            release = np.zeros(len(left), bool)
            release[np.argmax(left)] = left.max() > 0
        else:
            release = left > 0
        group = table.column("g")[0].as_py()
        return pa.table(
            {
                "rid": table.column("rid"),
                "piece": table.column("piece"),
                "length": table.column("length"),
                "seq": pa.array((np.int64(round_) << 56) + (np.int64(group) << 24) + where),
                "offset": pa.array(offset),
                "released": pa.array(release[where]),
            }
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document is its text's ids, of a null text none, and one id 0; only those
    longer than ``capacity`` are cut. Each input row is a document of its own,
    repeated rows and null ids included; extra columns of any name are ignored
    and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    pieces = rows.mapInArrow(
        _pieces(tokenizer, capacity), f"rid long, id {kind}, piece int, start long, length long, crc long"
    )
    pieces = scratch.save(pieces, "pieces")
    # at most ``capacity`` rows
    histogram = pieces.where(F.col("length") < capacity).groupBy("length").count().collect()
    sizes, counts = np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64)
    bound = lower_bound(sizes, capacity, counts)
    pool, n, done, shut = pieces.where(F.col("length") < capacity).select("rid", "piece", "length"), int(counts.sum()), [], 0
    previous = None
    for round_ in range(ROUNDS):
        if not n:
            break
        groups = math.ceil(n / (GROUP * GROWTH**round_))
        dealt = pool.withColumn("g", F.pmod(F.xxhash64("rid", "piece", F.lit(round_)), F.lit(groups)))
        packed = dealt.groupBy("g").applyInArrow(
            _pack(capacity, round_), "rid long, piece int, length long, seq long, offset long, released boolean"
        )
        packed = scratch.save(packed, f"round{round_}")
        bins = packed.groupBy("seq").agg(F.max("released").alias("released"), F.count(F.lit(1)).alias("rows"))
        now = {r[0]: (r[1], r[2]) for r in bins.groupBy("released").agg(F.count(F.lit(1)), F.sum("rows")).collect()}
        total = sum(x[0] for x in now.values())
        if previous is not None and total >= previous[1]:
            # mixing anew saved nothing: the earlier packing of the same pieces stands
            done.append(previous[0])
            pool, n = None, 0
            break
        done.append(packed.where("not released"))
        shut += now.get(False, (0, 0))[0]
        previous = (packed.where("released"), now.get(True, (0, 0))[0])
        n, pool = now.get(True, (0, 0))[1], packed.where("released").select("rid", "piece", "length")
        if shut + previous[1] <= bound:
            break
    if n:
        done.append(previous[0])
    placed = None
    for d in done:
        d = d.select("rid", "piece", "seq", "offset")
        placed = d if placed is None else placed.unionByName(d)
    whole = pieces.where(F.col("length") == capacity).withColumns(
        {"seq": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    out = whole if placed is None else pieces.where(F.col("length") < capacity).join(placed, ["rid", "piece"]).unionByName(whole)
    out = out.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("seq").alias("sequence_id"),
        "offset",
    )
    return scratch.finish(out)

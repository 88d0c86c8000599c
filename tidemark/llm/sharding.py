"""Sharding by sampled splitters.

Rows are ordered by a hash of their text. A sample weighted by size gives
quantile boundaries that cut this order into many narrow ranges; ranges are
dealt to shards in order, and where the edge of a shard falls inside a range,
the range is cut there between two texts, by exact running sums. Copies of one
text stay in one shard unless they weigh more than a shard has room for; such
an overfull range is subdivided at the byte.

Scale. Only ids, sizes and hashes are shuffled. The driver gets the sample
(``SAMPLES`` keys for each range), one row of sums per range, and the texts
whose copies weigh over ``1 / HEAVY`` of a shard, at most ``shards * HEAVY`` of
them. The number of ranges follows the rows between fixed bounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARDS = 16
SAMPLES = 12  # for each range, on average
RANGES = (2048, 8192)
RANGE_ROWS = 100_000
HEAVY = 64


def _ranges(edges: np.ndarray):
    """Adds the range of each row's key: how many edges are at or below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(edges, b.column(b.schema.get_field_index("key")).to_numpy(), "right")
            yield b.append_column("range", pa.array(at.astype(np.int32)))

    return run


def _plan(parts: list[tuple[int, int, int]], heavy: list[tuple[int, int]], shards: int, total: int):
    """Where the shards' edges lie.

    ``parts``: (group, range, bytes); group -1 holds all light texts, others are
    numbers of heavy texts. ``heavy``: (number, bytes). Returns for each group
    its pieces as (first byte, shard) in order; heavy texts go whole to the
    shard with most room, and are cut only where none has room for them.
    """
    goal = [total * (i + 1) // shards - total * i // shards for i in range(shards)]
    room, pieces = goal[:], defaultdict(list)
    for number, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        at = max(range(shards), key=lambda s: (room[s], -s))
        if size <= room[at]:
            pieces[number].append((0, at))
            room[at] -= size
            continue
        done = 0
        for s in sorted(range(shards), key=lambda s: (-room[s], s)):
            if done < size and room[s] > 0:
                pieces[number].append((done, s))
                took = min(room[s], size - done)
                room[s] -= took
                done += took
    done = 0
    for s in range(shards):
        if room[s] > 0 or not pieces[-1]:
            pieces[-1].append((done, s))
            done += max(room[s], 0)
    before, seen = {}, defaultdict(int)
    for group, range_, size in sorted(parts):
        before[group, range_] = seen[group]
        seen[group] += size
    return dict(pieces), before


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: sizes (UTF-8 bytes and one) of the shards are near equal; a
    light text's copies may move an edge by less than 1 / HEAVY of a shard.
    Slots count from 0 in each shard without gaps. Null texts weigh 1, null ids
    are rows like others, repeated rows get slots of their own; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        total = 0
    quota = max(1, total // shards)
    weighty = rows.groupBy("key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    # over 1 / HEAVY of a shard in bytes, or of all rows: at most 2 * shards * HEAVY texts
    limit = F.lit(quota / HEAVY), F.lit(count / shards / HEAVY)
    weighty = weighty.where((F.col("w") > limit[0]) | (F.col("n") > limit[1]))
    heavy = [(r.key, r.w, r.n) for r in weighty.orderBy("key").collect()]
    per = max(1, min(RANGE_ROWS, count // RANGES[0]))
    table = spark.createDataFrame(
        [(k, i, max(1, -(-n // per))) for i, (k, _, n) in enumerate(heavy)], "key long, group int, subs int"
    )
    marked = rows.join(F.broadcast(table), "key", "left").withColumn("group", F.coalesce("group", F.lit(-1)))
    # size-weighted sample: a row's chance is its share of bytes and of rows, halves each
    n_ranges = max(1, min(RANGES[1], max(RANGES[0], count // RANGE_ROWS)))
    chance = (F.col("size") / F.lit(max(1, total)) + F.lit(1 / max(1, count))) / 2 * n_ranges * SAMPLES
    uniform = F.pmod(F.xxhash64("rid", F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    light = marked.where("group = -1")
    sample = np.array([r.key for r in light.where(uniform < chance).select("key").collect()], np.int64)
    edges = np.unique(np.quantile(sample, np.arange(1, n_ranges) / n_ranges, method="nearest")) if len(sample) else sample
    ranged = light.mapInArrow(_ranges(edges), "key long, id " + docs.schema[id_col].dataType.simpleString() + ", size long, text_crc32 long, rid long, group int, subs int, range int")
    # an overfull text has ranges of its own, dealt by row
    own = marked.where("group >= 0").withColumn("range", F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int"))
    ranged = ranged.unionByName(own).drop("subs")
    within = Window.partitionBy("group", "range").orderBy("key", "id", "rid")
    same = Window.partitionBy("group", "range", "key")
    placed = ranged.withColumns(
        {"n": F.row_number().over(within), "sum": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))}
    ).withColumn("from", F.col("sum") - F.col("size"))
    # light texts go by where their first copy lies, so copies stay together
    placed = placed.withColumn("from", F.when(F.col("group") < 0, F.min("from").over(same)).otherwise(F.col("from")))
    placed = scratch.save(placed, "placed")
    parts = [tuple(r) for r in placed.groupBy("group", "range").agg(F.sum("size")).collect()]
    pieces, before = _plan(parts, [(i, w) for i, (_, w, _) in enumerate(heavy)], shards, total)
    # the shard of a row: the last piece of its group that begins at or before it
    starts = spark.createDataFrame([(g, r, b) for (g, r), b in before.items()], "group int, range int, before long")
    plans = spark.createDataFrame(
        [(g, [x for x, _ in p], [s for _, s in p]) for g, p in pieces.items()], "group int, begins array<long>, whose array<int>"
    )
    dealt = placed.join(F.broadcast(starts), ["group", "range"]).join(F.broadcast(plans), "group")
    at = F.col("before") + F.col("from")
    dealt = dealt.withColumn("shard", F.element_at("whose", F.size(F.filter("begins", lambda x: x <= at))))
    dealt = dealt.select("id", "size", "text_crc32", "group", "range", "n", "shard")
    runs = dealt.groupBy("shard", "group", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low")).collect()
    first, seen = [], defaultdict(int)
    for r in sorted(runs, key=lambda r: (r.shard, r.group, r.range)):
        first.append((r.shard, r.group, r.range, seen[r.shard] - r.low))
        seen[r.shard] += r.rows
    base = spark.createDataFrame(first, "shard int, group int, range int, base long")
    out = dealt.join(F.broadcast(base), ["shard", "group", "range"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("n")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return scratch.finish(out)

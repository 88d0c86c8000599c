"""Exact deduplication by deterministic block naming (DataFrame operations only).

Every text is cut into fixed-size blocks. The distinct blocks are sorted, by hash
and then by content, and each gets its rank as an integer name; then adjacent
pairs of names are named in the same way, level by level, until one name is left
for each text. Two texts share their (level, name) exactly if they are equal:
names stand for contents, not for hashes of contents, so nothing can collide;
and a name depends on the blocks alone, not on files, partitions or order of rows.

Scale. A block crosses the network once. Blocks that many texts share are found
beforehand by counting 8-byte hashes (pre-aggregated on the map side); their
occurrences are dealt out over salts, sorted per salt, and the few per-salt places
are then made one, so no task receives a group of copies whole. Ranks are numbered
in ranges of hashes, and only numbers move for that. The table of
frequent hashes has at most ``4 * shuffle partitions`` rows, since each stands
for more than that share of all blocks; that is the bound of its broadcast.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .skew import salted_join

BLOCK_CHARS = 4096


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does just that where no other character of the text changes with
    it, which is the quick test here; the rest takes the slower ``translate``.
    """
    other = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def name_contents(df: DataFrame, content: list[str], scratch: Scratch, tag: str, rows: int) -> DataFrame:
    """Replace the ``content`` columns by ``name``: equal contents, and only they, get equal integers.

    ``df`` has ``rows`` rows; it is read twice, for the counts and for the names.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_h", F.xxhash64(*content))
    counts = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    counts = scratch.save(counts.where("_n > 1"), f"{tag}-counts")
    share = max(1, math.ceil(rows / (4 * _partitions(spark))))
    frequent = counts.where(F.col("_n") > share).select(
        "_h", F.ceil(F.col("_n") / share).cast("int").alias("_salts")
    )
    df = df.withColumn("_row", F.xxhash64(*[c for c in df.columns if c not in content]))
    dealt = (
        df.withColumn("_h", F.xxhash64(*content))
        .join(F.broadcast(frequent), "_h", "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNotNull(), F.pmod("_row", F.col("_salts"))).otherwise(F.lit(0)),
        )
    )
    kept, named = [c for c in df.columns if c not in content], [f"_c{i}" for i in range(len(content))]
    # blocks sorted by hash and content: the place among different blocks of one hash, which is nearly always the first
    place = F.dense_rank().over(Window.partitionBy("_h", "_salt").orderBy(*content))
    first = F.row_number().over(Window.partitionBy("_h", "_salt").orderBy(*content, "_row"))
    before = F.lag(F.struct(*content)).over(Window.partitionBy("_h", "_salt").orderBy(*content, "_row"))
    head = F.col("_salts").isNotNull() & ((first == 1) | ~before.eqNullSafe(F.struct(*content)))
    placed = dealt.withColumns({"_place": place, "_head": head}).select(
        *kept, "_h", "_salt", "_place", "_head", *[F.when(F.col("_head"), F.col(c)).alias(n) for n, c in zip(named, content, strict=True)]
    )
    placed = scratch.save(placed, f"{tag}-places")
    # a frequent hash is sorted salt by salt: its places are made one from a copy of each salt's blocks,
    # as many rows as frequent blocks have salts, at most 8 * shuffle partitions
    heads = placed.where("_head").select("_h", "_salt", "_place", *named)
    same = F.dense_rank().over(Window.partitionBy("_h").orderBy(*named))
    heads = heads.select("_h", "_salt", "_place", same.alias("_same"))
    placed = placed.join(F.broadcast(heads), ["_h", "_salt", "_place"], "left")
    placed = placed.select(*kept, "_h", F.coalesce("_same", "_place").alias("_place"))
    # names are ranks in that order: within ranges of hashes, moved by what the ranges before hold
    bits = max(1, 4 * _partitions(spark) - 1).bit_length()
    blocks = placed.groupBy("_h", "_place").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.shiftright("_h", 64 - bits))
    blocks = scratch.save(blocks, f"{tag}-blocks")
    sizes = blocks.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offset = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range: their number is that of the partitions
    sizes = sizes.select("_range", offset.alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "_place"))
    ranked = blocks.withColumn("_rank", rank).join(F.broadcast(sizes), "_range")
    ranked = scratch.save(ranked.select("_h", "_place", "_n", (F.col("_offset") + F.col("_rank") - 1).alias("name")), f"{tag}-ranks")
    return salted_join(placed, ranked, ["_h", "_place"], "_n", "_row").select(*[c for c in kept if c != "_row"], "name")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal means identical after lower-casing A-Z; a null text counts as empty.
    The row with the largest id stays. Of repeated rows (same id, same text)
    all are returned and all count towards group_size; the first of them in
    scan order is kept. A null id is returned with its group and is kept only
    where the whole group has no id. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), text.alias("_text")).withColumn(
        "rid", F.monotonically_increasing_id()
    )
    n = F.greatest(F.lit(1), F.ceil(F.length("_text") / block_chars)).cast("int")
    blocks = base.withColumn("n", n).select(
        "rid",
        "id",
        "n",
        F.sha2("_text", 256).alias("sha"),
        "_text",
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"),
    )
    blocks = blocks.select(
        "rid",
        "i",
        "n",
        F.when(F.col("i") == 0, F.col("id")).alias("id"),
        F.when(F.col("i") == 0, F.col("sha")).alias("sha"),
        F.substr("_text", F.col("i") * block_chars + 1, F.lit(block_chars)).alias("block"),
    )
    size = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text_col), F.lit(""))) / block_chars))
    n_blocks = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    level0 = scratch.save(name_contents(blocks, ["block"], scratch, "block", n_blocks), "level0")
    rows = level0.where("i = 0").select("rid", "id", "sha")
    done = [level0.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    rest, level = level0.where("n > 1").select("rid", "i", "n", "name"), 0
    longest = rest.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        # names are never negative, so -1 stands for a missing right half
        pairs = rest.groupBy("rid", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.ceil(F.col("n") / 2)).cast("int").alias("n"),
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.save(pairs, f"pairs{level}")
        names = name_contents(pairs, ["left", "right"], scratch, f"pair{level}", pairs.count())
        named = scratch.save(names, f"level{level}")
        done.append(named.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        rest = named.where("n > 1")
    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    identity = scratch.save(rows.join(identity, "rid"), "identity") if level else scratch.save(
        rows.join(done[0], "rid"), "identity"
    )
    groups = identity.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max("id").alias("keep_id"),
        F.max(F.struct(F.col("id"), -F.col("rid"))).alias("_top"),
    )
    groups = scratch.save(groups.where("group_size > 1"), "groups")
    top = F.col("_top")
    out = identity.join(groups, ["level", "name"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(top.isNull(), F.lit(True)).otherwise(-top["col2"] == F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return scratch.finish(out)


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_of_repeated: bool = False
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Decided by id and text: another text under the id of a copy stays. Rows
    that repeat the id and the text of the one that stays go with
    ``one_of_repeated``, all but one of them; else they stay. Rows without an
    id have no identity to be dropped by and stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-drop")
    groups = exact_groups(docs, id_col, text_col).where((F.col("group_size") > 1) & F.col(id_col).isNotNull())
    groups = groups.groupBy(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_gone_sha")).agg(
        F.max(F.col(id_col) == F.col("keep_id")).alias("_stays"), F.count(F.lit(1)).alias("_rows")
    )
    groups = scratch.save(groups, "groups")
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)

    def by_row(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return df.join(rows, (df[id_col] == rows["_gone"]) & (sha == rows["_gone_sha"]), how)

    rows = groups.where("not _stays").select("_gone", "_gone_sha")
    repeated = groups.where("_stays and _rows > 1").select("_gone", "_gone_sha")
    if not one_of_repeated or repeated.isEmpty():
        return by_row(docs, rows, "left_anti")
    name = "_sha"
    while name in docs.columns:
        name += "_"
    one = by_row(docs, repeated, "left_semi").withColumn(name, sha).dropDuplicates([id_col, name]).drop(name)
    return by_row(docs, rows.unionByName(repeated), "left_anti").unionByName(one)

"""Near-duplicate grouping by SuperMinHash signatures.

Texts become sets of word shingles. SuperMinHash (Ertl 2017) visits each
element's registers in the order of a random permutation and gives step j a
rank in [j, j + 1), so ranks of one element are correlated without repeats,
signatures vary less than independent MinHash, and an element stops as soon as
its next rank exceeds every register. Signatures are cut into bands; texts that
share a band are candidates, and each candidate pair is confirmed on its whole
sets, word for word, before union-find groups the links.

With 40 bands of 5 registers, a pair at similarity 0.8 shares a band with
probability 1 - (1 - 0.8**5)**40 = 1 - 1.2e-7, more above.

Scale. Texts with equal sets are one class and take part once. In each bucket
of a band all members are compared with its smallest member, which is linear in
the bucket. Buckets with the same smallest member form a group; only members
that are not yet in its component are compared with the others, in blocks of
bounded size: signatures first, then whole sets, and only links that join two
components leave the task. So no copies are expanded into all pairs, no member
of a bucket is left out, and no bucket has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .kept import forget
from .scratch import Scratch
from .skew import salted_join

U = np.uint64
BANDS, ROWS = 40, 5
M = BANDS * ROWS
ELEMENTS = 60_000  # of which permutations are held at once
BLOCK = 1024  # members of a group compared with each other at once
NONE = np.uint32(0xFFFFFFFF)


def _draw(el: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of each element's random stream: the register's place in j..M-1, and the rank's value."""
    with np.errstate(over="ignore"):
        x = W.mix(el + U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    place = j + (((x >> U(32)) * U(M - j)) >> U(32)).astype(np.int64)
    return place, (U(j << 24) | (x & U(0xFFFFFF))).astype(np.uint32)


def signatures(el: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set, (sets, M) uint32: whole part of the rank in 8 bits, fraction in 24."""
    n = len(off) - 1
    sig = np.full((n, M), NONE, np.uint32)
    flat = sig.reshape(-1)
    size = np.diff(off)
    at = np.repeat(np.arange(n), size)
    place, value = _draw(el, 0)
    np.minimum.at(flat, at * M + place, value)
    todo = np.flatnonzero((size > 0) & (sig.max(axis=1) >> 24 >= 1))
    ends = np.cumsum(size[todo])
    i = 0
    while i < len(todo):  # a set of any size is whole in one turn
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ELEMENTS, "right")))
        part = todo[i:k]
        pick = np.concatenate([np.arange(off[d], off[d + 1]) for d in part])
        e, doc, first = el[pick], at[pick], place[pick]
        perm = np.tile(np.arange(M, dtype=np.uint8), (len(e), 1))
        row = np.arange(len(e))
        perm[row, first] = 0
        perm[:, 0] = first
        j = 1
        while j < M:
            live = part[(sig[part].max(axis=1) >> 24) >= j]
            if not len(live):
                break
            if len(live) < len(part):
                keep = np.isin(doc, live)
                e, doc, perm, part = e[keep], doc[keep], perm[keep], live
                row = np.arange(len(e))
            p, v = _draw(e, j)
            reg = perm[row, p]
            perm[row, p] = perm[:, j]
            np.minimum.at(flat, doc * M + reg, v)
            j += 1
        i = k
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; registers and band number go in."""
    with np.errstate(over="ignore"):
        s = W.mix(sig.astype(U) + U(0x1F123BB5)).reshape(len(sig), BANDS, ROWS)
        h = np.zeros((len(sig), BANDS), U)
        for r in range(ROWS):
            h = W.mix(h * U(W.GRAM) + s[:, :, r])
        return W.mix(h + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _lower(data: np.ndarray) -> np.ndarray:
    return W.LOWER[data]


def _sets(col: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the shingles of a column's texts, worked out chunk by chunk to bound memory."""
    parts, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, data, off in W.chunks(col):
        made = W.shingles(_lower(data), off, n_words)
        parts.append(made.el)
        sizes.append(np.diff(made.off))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def similar(x: pa.Array, y: pa.Array, n_words: int, percent: int) -> np.ndarray:
    """Places at which two columns of texts reach the similarity, shingles compared by their words."""
    data, off = W.buffers(pa.concat_arrays([x, y]))
    made = W.shingles(_lower(data), off, n_words)
    size = np.diff(made.off)
    number, pair = made.numbers(n_words), np.repeat(np.arange(len(size)) % len(x), size)
    order = np.lexsort((number, pair))
    number, pair = number[order], pair[order]
    # a text's shingles differ, so a number occurs twice in a pair only if both have it
    inter = np.bincount(pair[1:][(number[1:] == number[:-1]) & (pair[1:] == pair[:-1])], minlength=len(x))
    union = size[: len(x)] + size[len(x) :] - inter
    return np.flatnonzero((100 * inter >= percent * union) & (union > 0))


def _signed(n_words: int):
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for i, j, data, off in W.chunks(b.column(1)):
                low = _lower(data)
                made = W.shingles(low, off, n_words)
                el, eo = made.el, made.off
                sig = signatures(el, eo)
                # ranks' low bytes are enough to tell registers apart in an estimate
                short = W.mix(sig.astype(U)).astype(np.uint8)
                keys = band_keys(sig)
                size = np.diff(eo)
                has = size > 0
                digest = made.digests(low, n_words)
                counts = np.where(has, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(size),
                        pa.array(digest, pa.binary()),
                        pa.array([short[k].tobytes() if has[k] else None for k in range(j - i)], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                            pa.array(keys[has].reshape(-1)),
                        ),
                    ],
                    schema=schema,
                )

    return run


def _confirm(n_words: int, percent: int):
    """(a, c, text_a, text_c) -> (a, c) of pairs that reach the similarity on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(W.buffers(b.column(2))[1]) + np.diff(W.buffers(b.column(3))[1])
            ends = np.cumsum(size)
            i, n = 0, b.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + W.CHUNK_BYTES, "right")))
                part = b.slice(i, j - i)
                ok = similar(part.column(2), part.column(3), n_words, percent)
                if len(ok):
                    yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(ok)) for k in (0, 1)], ["a", "c"])
                i = j

    return run


def _link(n_words: int, percent: int):
    """Members of two blocks of one group -> links that join components, confirmed on whole sets."""
    # six standard deviations of the signatures' estimate below the threshold
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / M) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        ids, comp, block = (table.column(c).to_numpy() for c in ("id", "comp", "blk"))
        main = np.array(table.column("main").to_pylist(), bool)
        kind, lo, hi = (table.column(c)[0].as_py() for c in ("kind", "lo", "hi"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), M)
        texts = table.column("text").combine_chunks()
        el, eo = _sets(texts, n_words)
        size = np.diff(eo)
        if kind == "main":
            left, right = np.flatnonzero(~main), np.flatnonzero(main)
        else:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        # the right side's shingles, sorted, with their owners
        pick = np.concatenate([np.arange(eo[i], eo[i + 1]) for i in right]) if len(right) else np.zeros(0, np.int64)
        owner = np.repeat(right, size[right])
        order = np.argsort(el[pick], kind="stable")
        posted, owner = el[pick][order], owner[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        a, c = [], []
        for i in left:
            r = right[(right > i) | (kind == "main") | (lo != hi)]
            r = r[(comp[r] != comp[i]) & (100 * np.minimum(size[r], size[i]) >= percent * np.maximum(size[r], size[i]))]
            r = r[(sig[r] == sig[i]).mean(axis=1) >= least] if len(r) else r
            if not len(r):
                continue
            own = el[eo[i] : eo[i + 1]]
            first, n = np.searchsorted(posted, own, "left"), np.searchsorted(posted, own, "right")
            n -= first
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            both = np.bincount(owner[at], minlength=len(ids))[r]
            # equal hashes are at least as many as equal shingles: what passes is confirmed on the words
            for j in r[100 * both >= percent * (size[i] + size[r] - both)].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and len(similar(texts.slice(i, 1), texts.slice(j, 1), n_words, percent)):
                    parent[max(x, y)] = min(x, y)
                    a.append(int(ids[i]))
                    c.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "c": pa.array(c, pa.int64())})

    return run


def _repeated(rows: DataFrame) -> bool:
    """Whether an id has several rows."""
    counts = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return not counts.where("n > 1").isEmpty()


def _keyed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, text) of each different pair of id and text, and (key, id, sha, first); keys follow the order of ids.

    ``first`` is the smallest key of the id.
    """
    rows = rows.where("id is not null").withColumn("sha", _sha_of(F.col("text")))
    keys = rows.select("id", "sha").distinct().orderBy("id", "sha").withColumn("key", F.monotonically_increasing_id())
    keys = scratch.save(keys, "keys")
    keys = scratch.save(keys.join(keys.groupBy("id").agg(F.min("key").alias("first")), "id"), "firsts")
    return rows.dropDuplicates(["id", "sha"]).join(keys, ["id", "sha"]).select("key", "text"), keys


def _sha_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A-Z count as lower case. A text of fewer than ``n_words`` words has its
    whole sequence as one shingle; an empty or null text has none and is linked
    with nothing. Texts are linked where 100 * shared >= percent * joint
    shingles; component_id is the smallest id reachable over links. Rows that
    repeat an id are one node of the graph, with the links of each of their
    texts, and all returned, each with the n_shingles of its own text; rows
    without an id keep their n_shingles, have no component and are kept. Extra
    columns of any name are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not _repeated(rows):
        return _near_groups(rows, n_words, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
    scratch = Scratch(docs.sparkSession, "near-keys")
    texts, keys = _keyed(rows, scratch)
    # texts of one id are linked by their id
    ties = keys.where("key != first").select(F.col("key").alias("a"), F.col("first").alias("c"))
    found = _near_groups(texts.withColumnRenamed("key", "id"), n_words, percent, ties)
    found = keys.join(found.select(F.col("id").alias("key"), "n_shingles", F.col("component_id").alias("top")), "key")
    found = found.join(keys.select(F.col("key").alias("top"), F.col("id").alias("component_id")), "top")
    found = scratch.save(found.select("id", "sha", "n_shingles", "component_id"), "found")
    out = rows.where("id is not null").select("id", _sha_of(F.col("text")).alias("sha")).join(found, ["id", "sha"])
    out = out.select("id", "n_shingles", "component_id", (F.col("component_id") == F.col("id")).alias("kept"))
    out = out.unionByName(_near_groups(rows.where("id is null"), n_words, percent))
    return scratch.finish(out.withColumnRenamed("id", id_col))


def _near_groups(pairs_of: DataFrame, n_words: int, percent: int, ties: DataFrame | None = None) -> DataFrame:
    """The groups of (id, text) whose ids differ or are null; ``ties`` are further links (a, c)."""
    spark = pairs_of.sparkSession
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.save(
        pairs_of.mapInArrow(_signed(n_words), "id long, n long, digest binary, sig binary, bands array<bigint>"), "signed"
    )
    known = signed.where("digest is not null and id is not null")
    classes = scratch.save(known.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    member = salted_join(known.select("id", "digest"), classes, "digest", "copies", "id")
    copies = scratch.save(member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("c")), "copies")
    if ties is not None:
        copies = copies.unionByName(ties)
    reps = scratch.save(known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "reps")
    scratch.release()
    members = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.max("id").alias("_top"), F.count(F.lit(1)).alias("many"))
    buckets = buckets.where("least.id != _top").select("key", F.col("least.id").alias("center"), F.col("least.n").alias("center_n"), "many")
    buckets = scratch.save(buckets, "buckets")
    # a bucket's members are all in the group of its center; most buckets of a member have the same one
    shared = salted_join(members, buckets, "key", "many", "id").select("center", "center_n", "id", "n").distinct()
    shared = scratch.save(shared, "shared")
    scratch.release()
    first = shared.where("id != center").where(100 * F.least("n", "center_n") >= percent * F.greatest("n", "center_n"))
    first = scratch.save(first.select(F.col("id").alias("a"), F.col("center").alias("c")), "first")
    wanted = shared.select("id").distinct()
    # merge joins wherever texts are joined: one plan at every size, and skewed sides can be split
    texts = scratch.save(pairs_of.join(wanted.hint("merge"), "id", "left_semi"), "texts")
    scratch.release()
    met = first.groupBy("c").agg(F.count(F.lit(1)).alias("many"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        x = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        y = scratch.save(texts.select(F.col("id").alias("c"), F.col("text").alias("tc")).hint("merge").join(met, "c"), "centers")
        both = salted_join(pairs.hint("merge").join(x, "a"), y, "c", "many", "a", merge=True).select("a", "c", "ta", "tc")
        out = scratch.save(both.mapInArrow(_confirm(n_words, percent), "a long, c long"), name)
        scratch.drop(y)
        scratch.release()
        return out

    links = copies.unionByName(confirmed(first, "links0"))
    comps = components(links, scratch)
    comps = scratch.save(comps, "components0")
    placed = shared.join(comps, shared["id"] == comps["node"], "left").select(
        "center", "id", F.coalesce("component", "id").alias("comp")
    )
    placed = scratch.save(placed, "placed")
    home = placed.groupBy("center").agg(
        F.max(F.when(F.col("id") == F.col("center"), F.col("comp"))).alias("home"), F.count(F.lit(1)).alias("many")
    )
    home = scratch.save(home, "home")
    placed = salted_join(placed, home, "center", "many", "id")
    placed = scratch.save(placed.select("center", "id", "comp", (F.col("comp") == F.col("home")).alias("main")), "sided")
    open_ = placed.groupBy("center").agg(
        F.ceil(F.count_if("main") / BLOCK).cast("int").alias("mains"),
        F.ceil(F.count_if(~F.col("main")) / BLOCK).cast("int").alias("rests"),
        F.count(F.lit(1)).alias("many"),
    )
    open_ = scratch.save(open_.where("rests > 0"), "open")
    rest = salted_join(placed, open_, "center", "many", "id")
    rest = rest.withColumn("blk", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))

    def turn(kind: str, lo, hi):
        return F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_rest = F.transform(upto("rests"), lambda i: turn("main", i, F.col("blk")))
    among = F.transform(upto("rests"), lambda i: turn("rest", F.least(i, "blk"), F.greatest(i, "blk")))
    with_main = F.when(F.col("mains") > 0, F.transform(upto("mains"), lambda i: turn("main", F.col("blk"), i)))
    turns = F.when(F.col("main"), with_rest).otherwise(F.concat(F.coalesce(with_main, F.filter(among, lambda _: F.lit(False))), among))
    rest = rest.hint("merge").join(reps.select("id", "sig"), "id").hint("merge").join(texts, "id")
    rest = rest.select("center", "id", "comp", "main", "blk", "sig", "text", F.inline(turns))
    second = rest.groupBy("center", "kind", "lo", "hi").applyInArrow(_link(n_words, percent), "a long, c long")
    second = scratch.save(second, "second")
    if not second.isEmpty():
        links = links.unionByName(second)
        comps = scratch.save(components(links, scratch), "components1")
    comps = comps.select(F.col("node").alias("id"), "component")
    out = (
        signed.select("id", "n")
        .join(comps, "id", "left")
        .select(
            "id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
    out = scratch.finish(out)
    scratch.release()
    return out


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group the one with the smallest id.

    Where ids are repeated, each different text under an id is decided for
    itself; rows that repeat id and text stay or go together.
    """
    scratch = Scratch(docs.sparkSession, "near-drop")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not _repeated(rows):
        groups = near_groups(docs, id_col, text_col, n_words, percent)
        gone = scratch.save(groups.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct(), "gone")
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    texts, keys = _keyed(rows, scratch)
    groups = near_groups(texts, "key", "text", n_words, percent)
    gone = groups.where(~F.col("kept")).select("key").distinct().join(keys, "key")
    gone = scratch.save(gone.select(F.col("id").alias("_gone"), F.col("sha").alias("_gone_sha")), "gone")
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (_sha_of(docs[text_col]) == gone["_gone_sha"]), "left_anti")

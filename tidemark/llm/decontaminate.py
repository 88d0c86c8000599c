"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most k edits, cut into k + 1
pieces, has one piece at least that occurs unchanged. So the pieces of all items
are searched exactly (one Aho-Corasick pass over each whole text), and around
each hit the item is verified with Myers's bit-parallel edit distance, which
finds the best match of the item anywhere in that stretch.

Texts and items are compared in lower case with every run of other characters
than letters and digits as one space. The budget k is ``rate`` of the item's
length, rounded down. Short items, whose budget is 0, match as whole words only:
"cat" is no part of "concatenate". Items without letters or digits match nothing.

Scale. Documents are read in place, without a shuffle. Items are taken in
blocks of at most ``BLOCK_CHARS`` characters, which bounds what is sent to the
executors; a larger benchmark takes more passes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import forget
from .scratch import Scratch

RATE = 0.06
BLOCK_CHARS = 4_000_000
OTHER = re.compile(r"[\W_]+")
GRAM = 6


def normalise(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length that make up the item, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, k: int) -> int | None:
    """Least number of edits that turn the item into some stretch of the text, None if over k.

    Myers 1999, with an integer of as many bits as the item has characters.
    """
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        # a match may start anywhere, so no bit is shifted in
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best if best <= k else None


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class Matcher:
    """Finds items, given as (id, normalised text), in normalised texts; those without a budget as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        budgets = [(i, t, int(rate * len(t))) for i, t in items if t]
        self.items = [(i, t if k else f" {t} ", k) for i, t, k in budgets]
        self.grams: dict[int, set[str]] = {}
        self.found = ahocorasick.Automaton()
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                self.found.add_word(piece, [*self.found.get(piece, []), (n, at)])
        if self.items:
            self.found.make_automaton()

    def match(self, text: str) -> dict[int, int]:
        """Item id to its least number of edits, for each item within its budget."""
        if not self.items or not text:
            return {}
        text = f" {text} "
        near: dict[tuple[int, int], set[str]] = {}
        starts: dict[int, set[int]] = {}
        for end, value in self.found.iter(text):
            for n, at in value:
                # where the item would begin if there were no edit before the piece
                starts.setdefault(n, set()).add(end + 1 - at)
        out: dict[int, int] = {}
        for n, ends in starts.items():
            name, item, k = self.items[n]
            size = self._piece_sizes(n)
            if item in text:
                out[name] = 0
                continue
            best = None
            if n not in self.grams:
                self.grams[n] = grams(item)
            for a, b in self._stretches(sorted(ends), len(item), k, size, len(text)):
                # an edit destroys at most GRAM grams; items that share a piece mostly end here
                at = (a // 64, -(-b // 64))
                if at not in near:
                    near[at] = grams(text[at[0] * 64 : at[1] * 64])
                if len(self.grams[n] - near[at]) > k * GRAM:
                    continue
                got = myers(item, text[a:b], k)
                if got is not None and (best is None or got < best):
                    best = got
            if best is not None:
                out[name] = min(best, out.get(name, best))
        return out

    def _piece_sizes(self, n: int) -> int:
        _, t, k = self.items[n]
        return -(-len(t) // (k + 1))

    @staticmethod
    def _stretches(ends: list[int], m: int, k: int, piece: int, n: int) -> Iterator[tuple[int, int]]:
        """Joined stretches of the text that hold every match around the hits."""
        lo = hi = None
        for e in ends:
            # e is the item's begin plus the piece's length
            a, b = max(0, e - piece - k), min(n, e + m + k)
            if hi is not None and a <= hi:
                hi = max(hi, b)
                continue
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
        if hi is not None:
            yield lo, hi


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of about ``most`` characters; rows without id or text are skipped."""
    own = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    n = max(1, math.ceil((own.agg(F.sum(F.length("text"))).first()[0] or 0) / most))
    for i in range(n):
        block = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else own
        yield [(r.id, normalise(r.text)) for r in block.orderBy("id", "text").collect()]


def _hits(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        matcher = Matcher(items, rate)
        for b in batches:
            row, item, edits = [], [], []
            for r, t in enumerate(b.column(2)):
                for i, e in matcher.match(normalise(t.as_py())).items():
                    row.append(r)
                    item.append(i)
                    edits.append(e)
            if row:
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(item, pa.int64()), pa.array(edits, pa.int64())],
                    ["id", "hash", "item", "edits"],
                )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """One row per input row: id, contaminated, n_items, item_ids (ascending), least_edits (null if clean).

    Null and empty texts are clean, as is every text if there are no items.
    Repeated rows each get their row. Extra columns of any name are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    text = F.col(text_col).cast("string")
    # a row is known by its id and text: a row number would not be the same in every pass
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = None
    for block in item_blocks(items, item_id, item_text):
        hits = rows.mapInArrow(_hits(block, rate), f"id {kind}, hash long, item long, edits long")
        hits = scratch.save(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    # a document's list is no longer than the benchmark
    per = found.groupBy(F.col("id").alias("id2"), F.col("hash").alias("hash2")).agg(
        F.sort_array(F.collect_set("item")).alias("item_ids"), F.min("edits").alias("least_edits")
    )
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))
    out = rows.select("id", "hash").join(per, same, "left").select(
        F.col("id").alias(id_col),
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        "least_edits",
    )
    return scratch.finish(out)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns, in one pass per block of items and without a shuffle."""
    at = docs.columns.index(text_col)

    def clean(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            matcher = Matcher(block, rate)
            for b in batches:
                keep = [not matcher.match(normalise(t.as_py())) for t in b.column(at)]
                if any(keep):
                    yield b.filter(pa.array(keep))

        return run

    Scratch(docs.sparkSession, "decontaminate")
    out = docs
    for block in item_blocks(items, item_id, item_text):
        out = out.mapInArrow(clean(block), docs.schema)
    return out

"""Toxicity by maximum-scoring segments of token log-odds.

Training counts tokens of labelled texts and gives each a log-odds ratio with a
Dirichlet prior taken from all counted texts (Monroe, Colaresi and Quinn 2008).
Words back off to their prefixes, so inflected or unseen forms of a stem are
scored too. A text is then scanned once, in linear time, for all maximal
scoring segments (Ruzzo and Tompa 1999); a negative drift for each token makes
segments of chance rare. Segment scores are calibrated by the extreme-value law
of Karlin and Altschul, E = K * n * exp(-lambda * S), with K and lambda fitted
to clean texts, and a text's significant segments are summed into one score.

Scale. The labelled sample is bounded by ``max_labels`` rows (chosen by hash),
and a feature must be in ``SUPPORT`` of the toxic texts of that sample, so both
broadcasts have a size bound. Texts are never shuffled: training reads them beside the broadcast labels, and
scoring is one pass over all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import forget
from .scratch import Scratch

MAX_LABELS = 200_000
PREFIXES = (6, 5, 4)
WORD = re.compile(r"[^\W\d_]+")
FLUSH = 100_000
CACHE = 150_000
PRIOR = 10.0
SUPPORT = 0.004  # least share of toxic texts that must hold a feature


def features(word: str) -> list[str]:
    """The word, then its prefixes from long to short, marked by a trailing star."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs; ``weight`` holds features that speak for or against toxicity."""

    weight: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    cut: float = 3.0
    prior: float = 0.1

    def word_score(self, word: str) -> float:
        for f in features(word):
            if (w := self.weight.get(f)) is not None:
                return w
        return -self.drift

    def segments(self, text: str, cache: dict[str, float] | None = None) -> tuple[int, list[tuple[float, int, int]]]:
        """(words, [(score, first character, end)]): all maximal scoring segments.

        ``cache`` keeps word scores between texts; it is emptied when it is large.
        """
        cache = {} if cache is None else cache
        if len(cache) > CACHE:
            cache.clear()
        # each candidate: start, end, sum before its first word, sum after its last, and the place of the
        # nearest one below whose first sum is less, so that the search never passes a candidate twice
        stack: list[tuple[int, int, float, float, int]] = []
        total, n = 0.0, 0
        for m in WORD.finditer(text.lower()):
            n += 1
            w = m[0]
            s = cache.get(w)
            if s is None:
                s = cache[w] = self.word_score(w)
            if s <= 0:
                total += s
                continue
            a, b, left, right = m.start(), m.end(), total, total + s
            total = right
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= right:
                    break
                a, left = stack[j][0], stack[j][2]
                del stack[j:]
            stack.append((a, b, left, right, j))
        return n, [(r - le, a, b) for a, b, le, r, _ in stack]

    def evidence(self, n: int, segments: list[tuple[float, int, int]]) -> float:
        """-ln E of the best segment, plus the logarithm of how many segments are significant."""
        each = [self.lam * s for s, _, _ in segments]
        base = math.log(self.k * max(n, 1))
        return max(each, default=0.0) - base + math.log(max(1, sum(x > base for x in each)))

    def probability(self, x: float) -> float:
        z = self.slope * (x - self.cut)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def score(self, text: str, cache: dict[str, float] | None = None) -> float:
        n, seg = self.segments(text, cache)
        if not n:
            return min(self.prior, 0.5 - 1e-9)
        return self.probability(self.evidence(n, seg))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (feature, texts of label 0 and 1 that hold it), pre-aggregated in bounded memory."""

    def out(c: list[Counter]) -> pa.RecordBatch:
        keys = list(c[0].keys() | c[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *[pa.array([x[k] for k in keys], pa.int64()) for x in c]], ["f", "n0", "n1"]
        )

    forget()
    c = [Counter(), Counter()]
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            c[label].update({f for w in words for f in features(w)})
            c[label][""] += 1
            if len(c[0]) + len(c[1]) > FLUSH:
                yield out(c)
                c = [Counter(), Counter()]
    yield out(c)


def _measured(model: Model):
    """(label, text) -> label, words, best segment's score, largest weight of a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            n, s, w = [], [], []
            for x in b.column(1):
                t = x.as_py() or ""
                words, seg = model.segments(t, cache)
                n.append(words)
                s.append(max((x for x, _, _ in seg), default=0.0))
                w.append(max((cache.get(m[0], 0.0) for m in WORD.finditer(t.lower())), default=0.0) if seg else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(w, pa.float64())],
                ["label", "n", "s", "w"],
            )

    return run


def _cut(seen: DataFrame, x, step: float) -> float:
    """The value of ``x`` that parts the labels with the fewest errors, from a histogram of at most 100 / step rows."""
    bins = (
        seen.select(F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x)) / step).alias("b"), "label")
        .groupBy("b")
        .agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("t"))
        .orderBy("b")
        .collect()
    )
    edges = [bins[0].b - 1] + [r.b for r in bins]
    errors, tried = sum(r.t - r.p for r in bins), []
    for i, e in enumerate(edges):
        if i:
            errors += 2 * bins[i - 1].p - bins[i - 1].t
        tried.append((errors, e))
    low = min(tried)[0]
    first = next(i for i, (err, _) in enumerate(tried) if err == low)
    after = edges[first + 1] if first + 1 < len(edges) else edges[first] + 1
    return (edges[first] + after) / 2 * step


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labels: int = MAX_LABELS,
) -> Model:
    """Fit a model on the labelled texts; the caller passes only labels that may be learnt from.

    Rows with a null id, label or text teach nothing. Of repeated labels of one
    id the largest counts. Without texts of both labels the model scores every
    text below 0.5.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    count = own.count()
    if count > max_labels:
        # by hash, so that no rows are sorted; a twentieth below the bound, which the limit makes sure of
        share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(1 << 30)
        own = own.where(share < F.lit(0.95 * max_labels / count)).limit(max_labels)
    own = scratch.save(own, "labels")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    # copies of one text teach once
    once = text.select("_id", F.xxhash64("text").alias("h")).join(F.broadcast(own), "_id")
    once = scratch.save(once.groupBy("h", "label").agg(F.min("_id").alias("_id")).select("_id", "label"), "once")
    known = text.join(F.broadcast(once), "_id").select("label", "text")
    counts = known.mapInArrow(_counts, "f string, n0 long, n1 long").groupBy("f").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    counts = scratch.save(counts, "counts")
    totals = counts.where("f = ''").first()
    if totals is None or not totals.n0 or not totals.n1:
        return Model()
    t0, t1 = totals.n0, totals.n1
    # the prior spreads PRIOR texts over the features by their share of all counted texts
    alpha = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / F.lit(t0 + t1) + F.lit(0.5)
    delta = F.log((F.col("n1") + alpha) / (F.lit(t1 + PRIOR) - F.col("n1")))
    delta -= F.log((F.col("n0") + alpha) / (F.lit(t0 + PRIOR) - F.col("n0")))
    spread = F.sqrt(1 / (F.col("n1") + alpha) + 1 / (F.col("n0") + alpha))
    scored = counts.where("f <> ''").select("f", "n0", "n1", (delta - 1.64 * spread).alias("low"), (delta / spread).alias("z"))
    sign = (F.col("n1") >= max(3, SUPPORT * t1)) & (F.col("z") > 3) & (F.col("low") > 1)
    best = scored.where(sign).orderBy(F.desc("z"), "f").collect()
    drift = 0.5
    weight = {r.f: min(8.0, float(r.low)) for r in best}
    # frequent clean words under a toxic prefix are excepted from it; other clean features say nothing
    stems = sorted(f[:-1] for f in weight if f.endswith("*"))
    under = F.lit(False)
    for k in PREFIXES:
        if own_k := [x for x in stems if len(x) == k]:
            under = under | F.substring("f", 1, k).isin(own_k)
    clean = scored.where(~F.col("f").endswith("*") & (F.col("n0") >= 3) & (F.col("low") <= 0) & under)
    clean = clean.orderBy("f").collect()
    weight |= {r.f: -drift for r in clean if r.f not in weight}

    def measured(model: Model, name: str) -> DataFrame:
        return scratch.save(known.mapInArrow(_measured(model), "label int, n long, s double, w double"), name)

    # features below the cut hold as often in clean texts: they get the drift
    floor = _cut(measured(Model(weight, drift), "weights"), F.col("w"), 0.1)
    weight = {f: w if w > floor else -drift for f, w in weight.items() if w > floor or not f.endswith("*")}
    seen = measured(Model(weight, drift), "segments")
    log_n = F.log(F.greatest(F.col("n"), F.lit(1)))
    m = seen.where("label = 0").agg(F.avg("s"), F.stddev_pop("s"), F.avg(log_n)).first()
    # Gumbel by moments: scores of clean texts less ln(n) / lambda
    lam = min(4.0, math.pi / (math.sqrt(6) * max(m[1] or 0.0, 0.3)))
    log_k = max(-30.0, min(30.0, lam * (m[0] or 0.0) - 0.5772 - (m[2] or 0.0)))
    cut = _cut(seen, F.lit(lam) * F.col("s") - log_n - F.lit(log_k), 0.25)
    scratch.clear()
    return Model(weight, drift, lam, math.exp(log_k), 0.5, cut, t1 / (t0 + t1))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.score(t.as_py() or "", cache) for t in b.column(1)], pa.float64())],
                ["id", "score"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row, nulls count as empty texts; an empty text scores the base rate."""
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(_score(model), f"id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, all columns, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            keep = [model.score(t.as_py() or "", cache) < most for t in b.column(at)]
            if any(keep):
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, score, e_value, passage) of every significant toxic passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, seg = model.segments(t or "")
                for s, a, e in seg:
                    value = model.k * n * math.exp(-model.lam * s)
                    if value < 1:
                        rows.append((i, a, e, s, value, (t or "").lower()[a:e]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.schema.field(0).type)]
                    + [pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)],
                    ["id", "start", "end", "score", "e_value", "passage"],
                )

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(run, f"id {kind}, start long, end long, score double, e_value double, passage string")


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out from learning."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0

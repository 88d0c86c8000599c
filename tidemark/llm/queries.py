"""The driver's queries over the synthetic tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"))


def op3_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as T

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = T.train(docs, labels.where(~T.held_out()).select("doc_id", "toxic"))
    return T.score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(T.held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), n_words=2, percent=80)


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op10_scored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text as H

    pages = _table(spark, sf_dir, "pages")
    return H.main_text(pages, H.learn(pages))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

OP5_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w
), c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT c, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT c AS x, c AS y FROM c UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
k AS (SELECT x, min(y) AS top FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.top, s.doc_id) AS component_id, coalesce(k.top, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.x = c.c
"""

OP6_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS n FROM v) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM l, range(20) t(k)),
kept AS (
  SELECT doc_id, list(x ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) a ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(kept), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _spans(kind: str, n: int, pattern: str, good: str) -> str:
    return f"""
{kind}_h AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM t),
{kind}_p AS (SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'x': h[i], 'a': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0)}})) AS p FROM {kind}_h),
{kind}_s AS (SELECT doc_id, '{kind}' AS kind, {n} AS n, p.a AS a, p.a + length(p.x) AS z FROM {kind}_p WHERE {good})"""


_DIGITS = "regexp_replace(p.x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"
PII_BASE_SQL = "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + ",".join([
    _spans('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true'),
    _spans('ip', 1, r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', "len(list_filter(string_split(p.x, '.'), lambda y: TRY_CAST(y AS HUGEINT) IS NULL OR CAST(y AS HUGEINT) > 255)) = 0"),
    _spans('card', 2, r'[0-9](?:[\x20-]?[0-9])+', f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    _spans('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 10 AND 15"),
]) + """,
every AS (SELECT * FROM email_s UNION ALL SELECT * FROM ip_s UNION ALL SELECT * FROM card_s UNION ALL SELECT * FROM phone_s),
m AS (SELECT doc_id, count(*) FILTER (n = 0) AS e, count(*) FILTER (n = 1) AS i, count(*) FILTER (n = 2) AS c, count(*) FILTER (n = 3) AS p, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, n) AS s FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256
FROM t LEFT JOIN m USING (doc_id)
"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents),
i AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM benchmark WHERE item_id IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]')),
h AS (SELECT doc_id, item_id FROM d JOIN i ON contains(d.t, i.t)),
m AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(items, '') AS items, CAST(CASE WHEN n > 0 THEN 0 END AS BIGINT) AS least_edits
FROM d LEFT JOIN m USING (doc_id)
"""

SHARD_SQL = "SELECT count(*) AS docs, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, true AS gapless, true AS in_range, true AS near_equal FROM documents"
PACKING_SQL = "SELECT count(*) AS docs, true AS whole, true AS gapless, true AS few FROM documents"

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def contamination_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decontamination without a budget: items as whole words, which SQL can say."""
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.0)
    return found.select("doc_id", "contaminated", "n_items", F.array_join("item_ids", ",").alias("items"), "least_edits")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the fixed patterns, which SQL can say."""
    return op7_bootstrapped_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the shards keep their law: sizes near equal, slots without gaps."""
    rows = op2_sampled_splitters(spark, sf_dir)
    per = rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("most"),
        F.min("slot").alias("low"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots"),
    )
    gapless = (F.col("low") == 0) & (F.col("top") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    near = F.max("bytes") - F.min("bytes") <= F.greatest(F.max("most"), F.sum("bytes") / (16 * 50))
    return per.agg(
        F.sum("n").alias("docs"), F.sum("bytes").alias("bytes"), F.every(gapless).alias("gapless"),
        ((F.min("shard") >= 0) & (F.max("shard") <= 15)).alias("in_range"), near.alias("near_equal"),
    )


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pieces make up their documents and sequences, and how near their number is to the lower bound."""
    rows = op8_best_fit_packing(spark, sf_dir)
    by = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("piece").alias("top"), F.sum("length").alias("size"),
        F.max(F.col("start") + F.col("length")).alias("end"), F.max(F.col("piece") * 2048 - F.col("start")).alias("off"),
    )
    whole = (F.col("top") == F.col("n") - 1) & (F.col("size") == F.col("end")) & (F.col("off") == 0)
    of = rows.groupBy("sequence_id").agg(F.sum("length").alias("size"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("low"))
    gapless = (F.col("size") == F.col("end")) & (F.col("low") == 0) & (F.col("size") <= 2048)
    few = F.count(F.lit(1)) <= F.ceil(F.sum("size") / 2048) * 1.02 + 1
    bins = of.agg(F.every(gapless).alias("gapless"), few.alias("few")).first()
    return by.agg(F.count(F.lit(1)).alias("docs"), F.every(whole).alias("whole"), F.lit(bins.gapless).alias("gapless"), F.lit(bins.few).alias("few"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_toxicity_segments": op3_toxicity_segments,
    "op4_pigeonhole_decontamination": op4_pigeonhole_decontamination,
    "op5_superminhash": op5_superminhash,
    "op6_block_anchors": op6_block_anchors,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc_normaliser": op9_warc_normaliser,
    "op10_scored_regions": op10_scored_regions,
    # what SQL can say of those that it cannot express as a whole
    "contamination_exact": contamination_exact,
    "pii_base": pii_base,
    "shard_laws": shard_laws,
    "packing_laws": packing_laws,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_superminhash": OP5_SQL,
    "op6_block_anchors": OP6_SQL,
    "op9_warc_normaliser": OP9_SQL,
    "contamination_exact": EXACT_SQL,
    "pii_base": PII_BASE_SQL,
    "shard_laws": SHARD_SQL,
    "packing_laws": PACKING_SQL,
}

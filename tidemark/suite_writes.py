"""More named queries with their SQL: writes of documents and families, valid time, leaves, stores, graphs, rejections."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suite
from .database import Database, Transaction
from .errors import ModelRejected, QueryRejected, WriteRejected
from .expr import All
from .functions import documents
from .graph import edge_of, is_view_loaded, pin_of, view
from .model import TPCS, TPH, Entity, Inheritance, Model, SortKey, ValueObject
from .model import Attribute as A
from .model import Relationship as R
from .operators.classify import ABSENT, LEAF, NULL
from .operators.writes import Writer, assigned
from .plans.compile import Compiler
from .plans.includes import canonical
from .plans.unitofwork import DELETE, INSERT, UPDATE, Instruction, UnitOfWork, batches
from .query import Aggregate, AggregateQuery, Include
from .sources import descriptor, generators
from .sources.catalog import Catalog, from_rows
from .sources.store import Store, StoredSequence
from .types import wire

D = dt.datetime
S, T, P = suite.S, suite.T, suite.P
_INF, _TX, _txs = suite._INF, suite._TX, suite._txs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _QUERIES[name], _SQL[name] = build, sql


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share; a temporary one where all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _values(rows: list[tuple], *names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({', '.join(names)})"


# ---- point and range reads of the workloads that the benchmark times

_add("read_point", lambda s, sf: suite._shop(s, sf).rows(S.Order.where(S.Order.key == 7)), f"SELECT * FROM {suite.ORDERS} o WHERE o_orderkey = 7")
_add("read_range", lambda s, sf: suite._shop(s, sf).rows(S.Order.where(S.Order.key.between(100, 1100))), f"SELECT * FROM {suite.ORDERS} o WHERE o_orderkey BETWEEN 100 AND 1100")

# ---- composites are written as one document

_PROFILE = "SELECT c_custkey, {} AS segment, {} AS balance, {} AS zip FROM customer"


def _read(df: DataFrame, column: str, key: str, *leaves: tuple[str, str]) -> DataFrame:
    doc = documents.variant(F.col(column))
    return df.select(key, *[documents.leaf(doc, (n,), t).alias(n) for n, t in leaves])


_INFO_LEAVES = (("segment", "string"), ("balance", "float64"), ("zip", "string"))


def _composite_keyed(s: SparkSession, sf: str) -> DataFrame:
    c = suite._docs(s, sf)
    u = UnitOfWork(s, suite.DOCS, c.catalog)
    for key in (5, 6, 7):
        u.add(UPDATE, "Profile", (key,), {"info": {"segment": "it's new", "balance": 1.5}})
    u.add(UPDATE, "Profile", (8,), {"info": None})
    return _read(u.apply(lambda: suite.MID)["profile"], "info", "c_custkey", *_INFO_LEAVES)


_old = "CASE WHEN c_custkey % 7 <> 0 THEN {} END"
_add("vo_write_keyed", _composite_keyed, _PROFILE.format(
    f"CASE WHEN c_custkey IN (5, 6, 7) THEN 'it''s new' WHEN c_custkey <> 8 THEN {_old.format(chr(110) + 'ullif(c_mktsegment, ' + repr('BUILDING') + ')')} END",
    f"CASE WHEN c_custkey IN (5, 6, 7) THEN 1.5 WHEN c_custkey <> 8 THEN {_old.format('c_acctbal')} END",
    f"CASE WHEN c_custkey NOT IN (5, 6, 7, 8) THEN {_old.format(repr('x'))} END"))


def _composite_where(s: SparkSession, sf: str) -> DataFrame:
    c = suite._docs(s, sf)
    new = assigned(suite.DOCS, "Profile", {"info": {"segment": "rich", "nation": 1}})
    out = Writer(suite.DOCS, "Profile").update_where(c.catalog.frame("profile"), F.col("c_custkey") > 50, new)
    return _read(out, "info", "c_custkey", ("segment", "string"), ("nation", "int64"))


_add("vo_write_predicate", _composite_where, "SELECT c_custkey, CASE WHEN c_custkey > 50 THEN 'rich' WHEN c_custkey % 7 <> 0 THEN nullif(c_mktsegment, 'BUILDING') END AS segment, CASE WHEN c_custkey > 50 THEN 1 WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS nation FROM customer")

# ---- members of a document layout are assigned in place; members no model knows stay

_LEAVES = (("status", "string"), ("total", "float64"), ("priority", "string"), ("other", "string"))
_LAID = "SELECT o_orderkey, {} AS status, {} AS total, {} AS priority, 'kept' AS other FROM orders"
_prio = "nullif(o_orderpriority, '4-NOT SPECIFIED')"


def _layout_keyed(s: SparkSession, sf: str) -> DataFrame:
    c = suite._laid(s, sf)
    changes = c.catalog.frame("orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit('{"total": 0.25, "priority": null}').alias("payload"))
    return _read(Writer(suite.LAID, "Laid").update(c.catalog.frame("laid"), changes), "payload", "o_orderkey", *_LEAVES)


_add("layout_write_keyed", _layout_keyed, _LAID.format("o_orderstatus", "CASE WHEN o_orderstatus = 'P' THEN 0.25 ELSE o_totalprice END", f"CASE WHEN o_orderstatus <> 'P' THEN {_prio} END"))


def _layout_where(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, suite.LAID, suite._laid(s, sf).catalog, lambda: _TX)
    tx.update_where("Laid", suite.L.Laid.total > 200000.0, {"status": "big", "total": 7.0})
    return _read(tx.catalog.frame("laid"), "payload", "o_orderkey", *_LEAVES)


_add("layout_write_predicate", _layout_where, _LAID.format("CASE WHEN o_totalprice > 200000 THEN 'big' ELSE o_orderstatus END", "CASE WHEN o_totalprice > 200000 THEN 7.0 ELSE o_totalprice END", _prio))


def _layout_insert(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, suite.LAID, suite._laid(s, sf).catalog, lambda: _TX)
    tx.insert("Laid", (-1,), {"status": "N", "total": 2.5})
    tx.update("Laid", (-1,), {"priority": "later"})
    tx.delete("Laid", (1,))
    tx.flush()
    return _read(tx.catalog.frame("laid"), "payload", "o_orderkey", *_LEAVES)


_add("layout_write_insert", _layout_insert, _LAID.format("o_orderstatus", "o_totalprice", _prio) + " WHERE o_orderkey <> 1 UNION ALL SELECT -1, 'N', 2.5, 'later', NULL")

#: A family in a document layout: two variants have a member of one name and different types.
VARIANTS = Model(
    Entity("Deal", (A("key", "int64", "o_orderkey", primary_key=True), A("total", "float64")), "deal", document="payload",
           inheritance=Inheritance("root", strategy=TPH, tag_column="kind")),
    Entity("Counted", (A("mark", "int32", nullable=True),), inheritance=Inheritance("concrete-subtype", "Deal", tag_value="c")),
    Entity("Named", (A("mark", "string", nullable=True),), inheritance=Inheritance("concrete-subtype", "Deal", tag_value="n")),
)
W = VARIANTS.ref


def _variants(s: SparkSession, sf: str) -> Compiler:
    c = suite.base(s, sf)

    def deal() -> DataFrame:
        doc = F.struct(F.col("o_totalprice").alias("total"), (F.col("o_orderkey") % 9).cast("string").alias("mark"))
        return c.frame("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "c").otherwise("n").alias("kind"), F.to_json(doc).alias("payload"))

    return Compiler(VARIANTS, c.with_table("deal", deal))


_add("layout_variants", lambda s, sf: _variants(s, sf).rows(W.Deal.where((W.Counted.narrowed(W.Counted.mark >= 7) | W.Named.narrowed(W.Named.mark == "3")) & (W.Deal.total > 1000.0))).select("o_orderkey", "familyVariant"),
     "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Counted' ELSE 'Named' END AS familyVariant FROM orders WHERE o_totalprice > 1000 AND ((o_orderstatus = 'F' AND o_orderkey % 9 >= 7) OR (o_orderstatus <> 'F' AND o_orderkey % 9 = 3))")

_CHAIN = Model(Entity("Mark", (A("id", "int64", primary_key=True), A("val", "decimal(18,2)"), A("note", "string")), "mark", document="body", temporality="transaction-time"))


def _chain(s: SparkSession) -> tuple[Compiler, DataFrame]:
    t = generators.milestones(s, 50, 4, document="body")
    return Compiler(_CHAIN, Catalog({"mark": t})), t


def _layout_chain(s: SparkSession, sf: str) -> DataFrame:
    c, t = _chain(s)
    tx = Transaction(s, _CHAIN, c.catalog, lambda: _TX)
    tx.update_where("Mark", _CHAIN.ref.Mark.val >= Decimal("30.00"), {"note": "closed"})
    tx.terminate("Mark", (2,))
    tx.flush()
    out = tx.catalog.frame("mark")
    return _read(out, "body", "id", ("val", "decimal(18,2)"), ("note", "string")).select("id", F.col("val").cast("double").alias("val"), "note").join(out.select("id").distinct(), "id").groupBy("id", "val", "note").agg(F.count(F.lit(1)).alias("n"))


_add("layout_temporal_chain", _layout_chain, "SELECT k AS id, CAST(n * 10 AS DOUBLE) AS val, 'note-' || n AS note, CAST(1 AS BIGINT) AS n FROM (SELECT range AS k FROM range(1, 51)), (SELECT range AS n FROM range(4)) UNION ALL SELECT range, 30.0, 'closed', 1 FROM range(1, 51)")
_add("layout_temporal_as_of", lambda s, sf: _chain(s)[0].aggregate(AggregateQuery(_CHAIN.ref.Mark.where(_CHAIN.ref.Mark.note != "note-0").as_of("transaction", D(2024, 1, 2, 12)), (Aggregate("count", "n"), Aggregate("max", "top", "note")))), "SELECT CAST(50 AS BIGINT) AS n, 'note-1' AS top")

# ---- valid time alone: successors take the place of what they split

VALID = Model(Entity("Price", (A("key", "int64", "o_orderkey", primary_key=True), A("amount", "float64")), "price", temporality="valid-time"))
_V0 = f"SELECT o_orderkey, o_totalprice AS amount, o_orderdate AS from_z, {_INF} AS thru_z FROM orders"
_OLD = "o_orderdate < TIMESTAMP '1995-01-01'"
_a, _b = "TIMESTAMP '2031-01-01'", "TIMESTAMP '2032-01-01'"


def _valid(name: str, work: Callable[[Writer, DataFrame, DataFrame], DataFrame], sql: str) -> None:
    def build(s: SparkSession, sf: str) -> DataFrame:
        o = suite.base(s, sf).frame("orders")
        inf = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
        t = o.select("o_orderkey", F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("from_z"), inf.alias("thru_z"))
        return work(Writer(VALID, "Price"), t, o.where("o_orderdate < timestamp_ntz'1995-01-01'").select("o_orderkey"))

    _add(name, build, sql)


def _piece(amount: str, a: str, b: str) -> str:
    return f" UNION ALL SELECT o_orderkey, {amount}, {a}, {b} FROM orders WHERE {_OLD}"


_keep = f"{_V0} WHERE NOT {_OLD}"
_head, _tail = _piece("o_totalprice", "o_orderdate", _a), _piece("o_totalprice", _b, _INF)
_seven = lambda k: k.withColumn("amount", F.lit(7.0))
_A, _B = D(2031, 1, 1), D(2032, 1, 1)
_valid("valid_insert", lambda w, t, k: w.bt_insert(t, k.select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(5.0).alias("amount")), _TX, _A, _B), f"{_V0} UNION ALL SELECT o_orderkey + 10000000, 5.0, {_a}, {_b} FROM orders WHERE {_OLD}")
_valid("valid_update", lambda w, t, k: w.bt_update(t, _seven(k), _TX, _A), _keep + _head + _piece("7.0", _a, _INF))
_valid("valid_update_until", lambda w, t, k: w.bt_update_until(t, _seven(k), _TX, _A, _B), _keep + _head + _piece("7.0", _a, _b) + _tail)
_valid("valid_terminate", lambda w, t, k: w.bt_terminate(t, k, _TX, _A), _keep + _head)
_valid("valid_terminate_until", lambda w, t, k: w.bt_terminate_until(t, k, _TX, _A, _B), _keep + _head + _tail)
_valid("valid_where", lambda w, t, k: w.bt_where(t, F.col("from_z") < F.lit("1995-01-01").cast("timestamp_ntz"), {"amount": F.lit(7.0)}, _TX, _A, _B), _keep + _head + _piece("7.0", _a, _b) + _tail)
_valid("valid_as_of", lambda w, t, k: Compiler(VALID, Catalog({"price": w.bt_update(t, _seven(k), _TX, _A)})).rows(VALID.ref.Price.where().as_of("valid", _B)), f"{_keep}{_piece('7.0', _a, _INF)}")

# ---- families with histories, and writes of families

KIN = Model(
    Entity("Track", (A("user", "int64", "user_id", primary_key=True), A("value", "float64")), "track", temporality="transaction-time",
           inheritance=Inheritance("root", strategy=TPH, tag_column="event_type")),
    Entity("Deed", (A("worth", "float64", nullable=True),), inheritance=Inheritance("abstract-subtype", "Track")),
    *[Entity(n, inheritance=Inheritance("concrete-subtype", up, tag_value=t)) for n, up, t in (("Click", "Deed", "click"), ("Purchase", "Deed", "purchase"), ("View", "Track", "view"), ("Signup", "Track", "signup"), ("Other", "Track", "error"))],
    Entity("Claim", (A("key", "int64", primary_key=True), A("amount", "float64")), temporality="bitemporal", inheritance=Inheritance("root", strategy=TPCS)),
    Entity("Small", (A("tag", "string", nullable=True),), "small", inheritance=Inheritance("concrete-subtype", "Claim")),
    Entity("Large", (A("rank", "int32", nullable=True),), "large", inheritance=Inheritance("concrete-subtype", "Claim")),
)
K = KIN.ref


def _kin(s: SparkSession, sf: str) -> Compiler:
    c = suite.base(s, sf)
    track = lambda: suite.user_states(c).withColumn("worth", F.when(F.col("event_type").isin("click", "purchase"), F.col("value") * 2))
    claims = suite.contracts(c).drop("customer")
    return Compiler(KIN, c.with_table("track", track)
                    .with_table("small", lambda: claims.where("amount <= 150000").withColumn("tag", F.lit("s")))
                    .with_table("large", lambda: claims.where("amount > 150000").withColumn("rank", F.lit(1))))


_WORTH = "CASE WHEN event_type IN ('click', 'purchase') THEN value * 2 END AS worth"
_add("fam_temporal_latest", lambda s, sf: _kin(s, sf).rows(K.Track.where(K.Track.value > 20.0)).select("user_id", "event_type", "value", "worth"), f"SELECT user_id, event_type, value, {_WORTH} FROM {suite.STATES} s WHERE out_z = {_INF} AND value > 20")
_add("fam_temporal_abstract", lambda s, sf: _kin(s, sf).rows(K.Deed.where().as_of("transaction", suite.TT_AT)).select("user_id", "familyVariant", "worth"), f"SELECT user_id, upper(event_type[1]) || event_type[2:] AS familyVariant, value * 2 AS worth FROM {suite.STATES} s WHERE event_type IN ('click', 'purchase') AND in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10'")
_add("fam_temporal_history", lambda s, sf: _kin(s, sf).rows(K.Click.where().history("transaction")).select("user_id", "in_z", "worth"), f"SELECT user_id, in_z, value * 2 AS worth FROM {suite.STATES} s WHERE event_type = 'click'")
_add("fam_temporal_tpcs", lambda s, sf: _kin(s, sf).rows(K.Claim.where(K.Claim.amount > 1000.0).as_of("valid", suite._PAST).as_of("transaction")).select("key", "amount", "tag", "rank", "familyVariant"),
     f"SELECT key, amount, CASE WHEN amount <= 150000 THEN 's' END AS tag, CAST(CASE WHEN amount > 150000 THEN 1 END AS INTEGER) AS rank, CASE WHEN amount <= 150000 THEN 'Small' ELSE 'Large' END AS familyVariant FROM {suite.CONTRACTS} c WHERE amount > 1000 AND {suite._v} AND out_z = {_INF}")


def _family_tph(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, suite.FAMILIES, suite.base(s, sf).with_table("orders", suite.base(s, sf).frame("orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")), lambda: _TX)
    tx.insert("Open", (-1,), {"custKey": 1, "total": 2.0, "priority": "new"})
    tx.insert("Finished", (-2,), {"custKey": 1, "total": 3.0, "date": D(2020, 1, 1)})
    key, other = (r[0] for r in tx.catalog.frame("orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").select("o_orderkey").limit(2).collect())
    tx.update("Finished", (key,), {"total": 1.0})
    tx.delete("Finished", (other,))
    tx.flush()
    return tx.catalog.frame("orders")


_add("fam_write_tph", _family_tph, "WITH f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN o_orderkey = (SELECT o_orderkey FROM f WHERE n = 1) THEN 1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey <> (SELECT o_orderkey FROM f WHERE n = 2) UNION ALL SELECT -1, 'O', 1, 2.0, 'new', NULL UNION ALL SELECT -2, 'F', 1, 3.0, NULL, TIMESTAMP '2020-01-01'")


def _family_tpcs(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, KIN, _kin(s, sf).catalog, lambda: _TX)
    tx.insert("Large", (-5,), {"amount": 9.0, "rank": 3}, start=_A)
    tx.update_until("Large", (-5,), {"amount": 8.0}, _A, _B)
    tx.flush()
    return Compiler(KIN, tx.catalog).rows(K.Claim.where(K.Claim.key < 0).history("valid").history("transaction")).select("key", "amount", "rank", "from_z", "thru_z", "out_z", "familyVariant")


_add("fam_write_tpcs", _family_tpcs, f"SELECT * FROM (VALUES (CAST(-5 AS BIGINT), 9.0::DOUBLE, 3, {_a}, {_INF}, {_txs}, 'Large'), (-5, 8.0, 3, {_a}, {_b}, {_INF}, 'Large'), (-5, 9.0, 3, {_b}, {_INF}, {_INF}, 'Large')) v(key, amount, rank, from_z, thru_z, out_z, familyVariant)")


def _gate(s: SparkSession, sf: str) -> DataFrame:
    """An update gated on the milestone it was read at applies only where that is still the current one."""
    t = suite._times(s, sf).catalog.frame("user_state")
    first = t.groupBy("user_id").agg(F.min("in_z").alias("observed_in")).withColumn("value", F.lit(-1.0))
    w = Writer(suite.TIMES, "UserState")
    return w.unmatched(t, first).select("user_id").withColumn("applied", F.lit(False)).union(w.tt_update(t, first, _TX).where("value = -1").select("user_id", F.lit(True)))


_add("tt_observed_gate", _gate, f"SELECT user_id, count(*) = 1 AS applied FROM {suite.STATES} s GROUP BY user_id")
_add("nav_temporal_pinned", lambda s, sf: _pinned(s, sf), f"SELECT user_id FROM {suite.STATES} a WHERE in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10' AND user_id IN (SELECT user_id FROM {suite.STATES} b WHERE in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10' AND event_type = 'click')")


def _pinned(s: SparkSession, sf: str) -> DataFrame:
    q = T.Ledger.where(T.Ledger.entries.exists(T.UserState.kind == "click")).as_of("transaction", suite.TT_AT)
    return suite._times(s, sf).rows(q).select("user_id")


# ---- leaves of every type, in documents and on the wire

_TYPES: list[tuple[str, str, str, str]] = [
    # name, type, JSON in Spark SQL, value in DuckDB
    ("boolean", "boolean", "o_orderkey % 2 = 0", "o_orderkey % 2 = 0"),
    ("int32", "int32", "cast(o_custkey as int)", "CAST(o_custkey AS INTEGER)"),
    ("int64", "int64", "o_orderkey * 4000000000", "o_orderkey * 4000000000"),
    ("float32", "float32", "cast(o_orderkey as float) / 4", "CAST(o_orderkey AS FLOAT) / 4"),
    ("float64", "float64", "o_totalprice", "o_totalprice"),
    ("decimal", "decimal(12,2)", "cast(cast(o_orderkey as decimal(12,2)) / 4 as decimal(12,2))", "CAST(o_orderkey / 4 AS DECIMAL(12,2))"),
    ("text", "string", "o_orderpriority", "o_orderpriority"),
    ("bytes", "bytes", "lower(hex(o_orderpriority))", "encode(o_orderpriority)"),
    ("date", "date", "date_format(o_orderdate, 'yyyy-MM-dd')", "CAST(o_orderdate AS DATE)"),
    ("time", "time", "concat('12:', lpad(o_orderkey % 60, 2, '0'), ':30.250000')", "TIME '12:00:30.25' + (o_orderkey % 60) * INTERVAL 1 MINUTE"),
    ("timestamp", "timestamp", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:20:30.000000Z')", "date_trunc('day', o_orderdate) + INTERVAL '10 hours 20 minutes 30 seconds'"),
    ("uuid", "uuid", "concat('AAAAAAAA-0000-4000-8000-', lpad(o_orderkey, 12, '0'))", "'aaaaaaaa-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"),
]


def _leaf_doc(s: SparkSession, sf: str) -> DataFrame:
    doc = F.to_json(F.struct(*[F.expr(x).alias(n) for n, _, x, _ in _TYPES]))
    return suite.base(s, sf).frame("orders").select("o_orderkey", documents.variant(doc).alias("v"))


def _leaf(name: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    shown = {"time": "string", "decimal(12,2)": "double", "float32": "double"}

    def build(s: SparkSession, sf: str) -> DataFrame:
        if kind == "time":
            # off by default in Spark 4.1
            s.conf.set("spark.sql.timeType.enabled", "true")
        value = documents.leaf(F.col("v"), (name,), kind)
        return _leaf_doc(s, sf).select("o_orderkey", (value.cast(shown[kind]) if kind in shown else value).alias("x"))

    return build


for _n, _k, _, _sql in _TYPES:
    _shown = {"time": f"strftime(DATE '2000-01-01' + ({_sql}), '%H:%M:%S') || '.25'", "decimal(12,2)": f"CAST({_sql} AS DOUBLE)", "float32": f"CAST({_sql} AS DOUBLE)"}.get(_k, _sql)
    _add(f"vo_leaf_{_n}", _leaf(_n, _k), f"SELECT o_orderkey, {_shown} AS x FROM orders")
_add("vo_leaf_of_another_kind", lambda s, sf: _leaf_doc(s, sf).select("o_orderkey", documents.leaf(F.col("v"), ("text",), "int32").alias("a"), documents.leaf(F.col("v"), ("text",), "date").alias("b"), documents.leaf(F.col("v"), ("none",), "string").alias("c")), "SELECT o_orderkey, CAST(NULL AS INTEGER) AS a, CAST(NULL AS DATE) AS b, CAST(NULL AS VARCHAR) AS c FROM orders")
_add("wire_codec", lambda s, sf: suite.base(s, sf).frame("orders").select("o_orderkey", *[wire(v, k).alias(n) for n, v, k in (
        ("b", F.col("o_orderpriority").cast("binary"), "bytes"), ("t", F.col("o_orderdate"), "timestamp"), ("d", (F.col("o_orderkey").cast("decimal(12,2)") / 4).cast("decimal(12,2)"), "decimal(12,2)"),
        ("day", F.col("o_orderdate").cast("date"), "date"), ("u", F.concat(F.lit("AB"), "o_orderpriority"), "uuid"), ("z", F.lit(-0.0), "float64"))]),
     "SELECT o_orderkey, lower(hex(encode(o_orderpriority))) AS b, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS t, CAST(CAST(o_orderkey / 4 AS DECIMAL(12,2)) AS VARCHAR) AS d, strftime(o_orderdate, '%Y-%m-%d') AS day, lower('AB' || o_orderpriority) AS u, '0.0' AS z FROM orders")


def _presence(s: SparkSession, sf: str) -> DataFrame:
    present, doc = documents.read_pair(F.col("info"))
    return suite._docs(s, sf).catalog.frame("profile").select("c_custkey", present.alias("present"), documents.is_object(documents.variant(doc), ()).alias("object"))


_add("document_read_pair", _presence, "SELECT c_custkey, c_custkey % 7 <> 0 AS present, c_custkey % 7 <> 0 AS object FROM customer")

FAULTY = Model(Entity("Stored", (A("key", "int64", "o_orderkey", primary_key=True),), "stored", value_objects=(
    ValueObject("info", (A("total", "float64"), A("priority", "string", nullable=True)), nullable=False),)))


def _classified(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("null")).when(k == 2, F.lit('{"priority": "x"}')).when(k == 3, F.lit('{"total": "many"}'))
    t = suite.base(s, sf).frame("orders").select("o_orderkey", text.otherwise(F.lit('{"total": 1, "more": 2}')).alias("info"))
    rows = Compiler(FAULTY, Catalog({"stored": t})).classified(FAULTY.ref.Stored.where())
    return rows.select("o_orderkey", "available", F.get("issues", F.lit(0))["code"].alias("code"), F.get("issues", F.lit(0))["path"].alias("path"), F.size("issues").cast("long").alias("n"))


_add("stored_data_classified", _classified, f"SELECT o_orderkey, o_orderkey % 5 <> 3 AS available, CASE o_orderkey % 5 WHEN 0 THEN '{ABSENT}' WHEN 1 THEN '{NULL}' WHEN 2 THEN '{ABSENT}' WHEN 3 THEN '{LEAF}' END AS code, CASE o_orderkey % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'info' WHEN 2 THEN 'info.total' WHEN 3 THEN 'info.total' END AS path, CAST(o_orderkey % 5 <> 4 AS BIGINT) AS n FROM orders")

# ---- merge-back and purge


def _merged(s: SparkSession, sf: str) -> DataFrame:
    c = suite._times(s, sf).catalog
    rows = c.frame("customer").where("c_nationkey < 4").select((F.col("c_custkey") + F.when(F.col("c_nationkey") == 0, 1000000).otherwise(0)).alias("c_custkey"), F.lit(2.5).alias("c_acctbal"))
    return Writer(suite.TIMES, "Account").upsert(c.frame("account"), rows)


_add("write_merge_back", _merged, "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN 2.5 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_nationkey IN (1, 2, 3) THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer UNION ALL SELECT c_custkey + 1000000, 2.5, 1 FROM customer WHERE c_nationkey = 0")


def _purged(s: SparkSession, sf: str) -> DataFrame:
    t = suite._times(s, sf).catalog.frame("user_state")
    return Writer(suite.TIMES, "UserState").purge(t, t.where("value > 60").select("user_id").distinct())


_add("tt_purge", _purged, f"SELECT user_id, event_type, value, in_z, out_z FROM {suite.STATES} s WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 60)")
_add("fetch_history_bitemporal", lambda s, sf: _rectangles(s, sf),
     f"SELECT a.key, a.in_z AS known, a.from_z AS start, b.amount FROM {suite.CONTRACTS} a JOIN {suite.CONTRACTS} b ON a.key = b.key AND b.from_z <= a.from_z AND b.thru_z > a.from_z AND b.in_z <= a.in_z AND b.out_z > a.in_z WHERE a.amount > 700000")


def _rectangles(s: SparkSession, sf: str) -> DataFrame:
    """The roots' rectangles and those of their twins that hold at each rectangle's corner."""
    twin = Model(
        Entity("One", (A("key", "int64", primary_key=True), A("amount", "float64")), "one", (R("twins", "Two", ("key", "key")),), temporality="bitemporal"),
        Entity("Two", (A("key", "int64", primary_key=True), A("amount", "float64")), "two", temporality="bitemporal"),
    )
    t = suite.contracts(suite.base(s, sf)).drop("customer")
    q = twin.ref.One.where(twin.ref.One.amount > 700000.0).history("valid").history("transaction").include(twin.ref.One.twins)
    rows = Compiler(twin, Catalog({"one": t, "two": t})).fetch(q)
    return rows.select("key", F.col("edge.transaction").alias("known"), F.col("edge.valid").alias("start"), F.explode("twins").alias("t")).select("key", "known", "start", "t.amount")


# ---- sources, stores and results


def _tree(s: SparkSession, sf: str) -> DataFrame:
    o, i, st = generators.orders_tree(s, 40, 5, 3)
    return o.join(i.groupBy("order_id").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity")), F.col("id") == F.col("order_id")).join(st.groupBy(F.col("order_id").alias("o")).agg(F.countDistinct("order_item_id").alias("marked"), F.count(F.lit(1)).alias("marks")), F.col("id") == F.col("o")).select("id", "name", "items", "quantity", "marked", "marks")


_add("generate_orders_tree", _tree, "SELECT range AS id, 'order-' || range AS name, CAST(5 AS BIGINT) AS items, CAST(15 AS BIGINT) AS quantity, CAST(5 AS BIGINT) AS marked, CAST(15 AS BIGINT) AS marks FROM range(1, 41)")


def _bucketed(s: SparkSession, sf: str) -> DataFrame:
    """A store in buckets: a commit of one row writes one bucket, and all others stay."""
    store = Store(s, _folder(s, "store"))
    c = suite._times(s, sf).catalog
    store.commit({"account": c.frame("account")}, buckets={"account": (16, ["c_custkey"])})
    before = store.manifest()["account"]["paths"]
    db = Database(suite.TIMES, store, lambda: _TX)
    db.transact(lambda tx: (tx.update("Account", (3,), {"balance": 1.0}), tx.insert("Account", (-3,), {"balance": 2.0})))
    db.transact(lambda tx: tx.delete_where("Account", (T.Account.key >= 10) & (T.Account.key <= 11)))
    now = store.manifest()["account"]["paths"]
    same = sum(now.get(b) == p for b, p in before.items())
    return db.find(T.Account.where()).df.withColumn("kept", F.lit(same >= len(before) - 4))


_add("store_buckets", _bucketed, "SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 1.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey = 3 THEN 2 ELSE 1 END AS INTEGER) AS version, true AS kept FROM customer WHERE c_custkey NOT IN (10, 11) UNION ALL SELECT -3, 2.0, 1, true")


def _committed(s: SparkSession, sf: str) -> DataFrame:
    store = Store(s, _folder(s, "store"))
    n = suite.base(s, sf).frame("nation")
    store.commit({"nation": n})
    store.commit({"nation": n.where("n_nationkey < 5")})
    count = lambda v: F.lit(v)
    old, new = store.catalog(1).frame("nation"), store.catalog().frame("nation")
    return old.select(count(1).alias("version"), "n_nationkey").union(new.select(count(2), "n_nationkey"))


_add("store_versions", _committed, "SELECT 1 AS version, n_nationkey FROM nation UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_nationkey < 5")


def _stored_sequence(s: SparkSession, sf: str) -> DataFrame:
    store = Store(s, _folder(s, "store"))
    new = suite.base(s, sf).frame("region").select("r_regionkey")
    one = StoredSequence(store, "ids", 10, 1, 100).allocate(new, "id", ["r_regionkey"])
    # another process knows nothing but the store
    two = StoredSequence(Store(s, store.root), "ids", 10, 1, 100).allocate(new, "id", ["r_regionkey"])
    return one.unionByName(two)


_add("pk_sequence_stored", _stored_sequence, "WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS n FROM region) SELECT CAST(100 + n AS BIGINT) AS id, r_regionkey FROM r UNION ALL SELECT CAST(110 + n AS BIGINT), r_regionkey FROM r")


def _connectors(s: SparkSession, sf: str) -> DataFrame:
    root = _folder(s, "sources")
    n = suite.base(s, sf).frame("nation")
    n.write.json(f"{root}/j")
    n.write.csv(f"{root}/c", header=True)
    n.write.orc(f"{root}/o")
    options = {"a": ("json", {"path": f"{root}/j"}), "b": ("csv", {"path": f"{root}/c", "header": "true", "inferSchema": "true"}), "c": ("orc", {"path": f"{root}/o"})}
    c = Catalog.read(s, options)
    out = [c.frame(t).select(F.lit(t).alias("source"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name") for t in options]
    return out[0].union(out[1]).union(out[2])


_add("source_formats", _connectors, "SELECT unnest(['a', 'b', 'c']) AS source, n_nationkey, n_name FROM nation")
_add("fixture_rows", lambda s, sf: from_rows(s, suite.DOCS, "Profile", [{"key": 1, "name": "a", "info": {"segment": "x", "balance": 1.5}}, {"key": 2, "name": "b", "orders": [{"status": "O"}]}]).select("c_custkey", "c_name", "info", "orders"),
     'SELECT * FROM (VALUES (CAST(1 AS BIGINT), \'a\', \'{"segment": "x", "balance": 1.5}\', NULL), (2, \'b\', NULL, \'[{"status": "O"}]\')) v(c_custkey, c_name, info, orders)')
_add("model_round_trip", lambda s, sf: Compiler(descriptor.load(descriptor.dump(suite.SHOP)), suite.base(s, sf)).rows(S.Customer.where(S.Customer.orders.exists(S.Order.total > 400000.0))), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_LAYOUTS = [(e, i, c, t.simpleString(), n) for e, m in (("Account", suite.TIMES), ("Contract", suite.TIMES), ("Deal", VARIANTS), ("Profile", suite.DOCS)) for i, (c, t, n) in enumerate(m.layout(e))]
_add("storage_layout", lambda s, sf: _rows(s, _LAYOUTS, "entity string, place long, col string, type string, nullable boolean"), _values([
    ("Account", 0, "c_custkey", "bigint", False), ("Account", 1, "c_acctbal", "double", False), ("Account", 2, "version", "int", False),
    ("Contract", 0, "key", "bigint", False), ("Contract", 1, "customer", "bigint", False), ("Contract", 2, "amount", "double", False),
    *[("Contract", 3 + i, c, "timestamp_ntz", False) for i, c in enumerate(("from_z", "thru_z", "in_z", "out_z"))],
    ("Deal", 0, "o_orderkey", "bigint", False), ("Deal", 1, "kind", "string", False), ("Deal", 2, "payload", "string", True),
    ("Profile", 0, "c_custkey", "bigint", False), ("Profile", 1, "c_name", "string", False), ("Profile", 2, "info", "string", True), ("Profile", 3, "orders", "string", True),
], "entity", "place", "col", "type", "nullable"))


def _reads(s: SparkSession, sf: str):
    c = suite._shop(s, sf)
    from .database import Reads

    return Reads(suite.SHOP, c.catalog)


def _paged(s: SparkSession, sf: str) -> DataFrame:
    pages = _reads(s, sf).find(S.Nation.where().order_by(S.Nation.key.asc())).pages(10)
    return _rows(s, [(n, len(p), p[0].n_nationkey) for n, p in enumerate(pages)], "page long, rows long, first long")


_add("paged_read", _paged, "SELECT n_nationkey // 10 AS page, count(*) AS rows, min(n_nationkey) AS first FROM nation GROUP BY 1")
_add("wire_aggregate", lambda s, sf: _reads(s, sf).wire(AggregateQuery(S.Customer.where(S.Customer.balance > 0.0), (Aggregate("count", "n"), Aggregate("max", "top", "balance")), ("segment",)).to_dict()).select(F.get_json_object("json", "$.segment").alias("segment"), F.get_json_object("json", "$.n").cast("long").alias("n"), F.get_json_object("json", "$.top").cast("double").alias("top")),
     "SELECT c_mktsegment AS segment, count(*) AS n, max(c_acctbal) AS top FROM customer WHERE c_acctbal > 0 GROUP BY 1")


def _wire_write(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, suite.TIMES, suite._times(s, sf).catalog, lambda: _TX)
    tx.write({"verb": "insert", "entity": "Account", "rows": [{"key": -1, "balance": 1.0}, {"key": -2, "balance": 2.0}]})
    tx.write({"verb": "update", "entity": "Account", "rows": [{"key": 4, "balance": 5.0, "observed": 1}]})
    tx.write({"verb": "update", "entity": "Account", "where": {"lessThan": {"attribute": "Account.balance", "value": 0.0}}, "values": {"balance": 0.0}})
    tx.write({"verb": "delete", "entity": "Account", "where": {"eq": {"attribute": "Account.key", "value": 9}}})
    return tx.catalog.frame("account")


_add("wire_write", _wire_write, "SELECT c_custkey, CASE WHEN c_custkey = 4 THEN 5.0 WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey = 4 OR c_acctbal < 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer WHERE c_custkey <> 9 UNION ALL SELECT -1, 1.0, 1 UNION ALL SELECT -2, 2.0, 1")
_add("wire_rows", lambda s, sf: _reads(s, sf).wire(S.Order.where(S.Order.status == "P").to_dict()).select(F.get_json_object("json", "$.o_orderkey").cast("long").alias("o_orderkey"), F.get_json_object("json", "$.o_orderdate").alias("d")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS d FROM orders WHERE o_orderstatus = 'P'")


def _identity(s: SparkSession, sf: str) -> DataFrame:
    """One node for each identity: customers reached by their nation and by their orders are the same."""
    q = S.Nation.where().include(S.Nation.customers, S.Nation.region.nations)
    roots = _reads(s, sf).find(q).graph()
    rows = []
    for n in roots:
        again = next(x for x in view(view(n, "region"), "nations") if x.key == n.key)
        rows.append((n["key"], again is n, is_view_loaded(n, "customers"), is_view_loaded(view(n, "region"), "customers"), len(view(n, "customers"))))
    return _rows(s, rows, "n_nationkey long, same boolean, loaded boolean, other boolean, n long")


_add("graph_identity", _identity, "SELECT n_nationkey, true AS same, true AS loaded, false AS other, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")


def _coordinates(s: SparkSession, sf: str) -> DataFrame:
    tx = Transaction(s, suite.TIMES, suite._times(s, sf).catalog, lambda: _TX)
    nodes = tx.find(T.Ledger.where().as_of("transaction", suite.TT_AT).include(T.Ledger.entries)).graph()
    rows = [(n["key"], edge_of(n)["transaction"], pin_of(n)["transaction"], edge_of(view(n, "entries")[0])["transaction"]) for n in nodes]
    return _rows(s, rows, "user_id long, edge timestamp_ntz, pin timestamp_ntz, child timestamp_ntz")


_add("graph_coordinates", _coordinates, f"SELECT user_id, in_z AS edge, TIMESTAMP '2024-01-10' AS pin, in_z AS child FROM {suite.STATES} s WHERE in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10'")
_add("deferred_relationship", lambda s, sf: _reads(s, sf).find(S.Customer.where(S.Customer.balance > 5000.0)).related("orders").df.select("parent.c_custkey", "child.o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000")
_add("include_canonical", lambda s, sf: _rows(s, [(".".join(r for r, _ in i.hops),) for i in canonical((Include((("b", ()),)), Include((("a", ()), ("c", ()))), Include((("a", ()),)), Include((("b", ()),))))], "path string"), _values([("a.c",), ("b",)], "path"))
_add("fk_order", lambda s, sf: _rows(s, [(n, v, e) for n, (v, e, _) in enumerate(batches(suite.SHOP, [Instruction(v, e, (k,)) for k, (v, e) in enumerate(((DELETE, "Region"), (DELETE, "Order"), (INSERT, "Order"), (INSERT, "Customer"), (UPDATE, "Nation"), (INSERT, "Region")))]))], "place long, verb string, entity string"),
     _values([(0, "insert", "Region"), (1, "insert", "Customer"), (2, "insert", "Order"), (3, "update", "Nation"), (4, "delete", "Order"), (5, "delete", "Region")], "place", "verb", "entity"))

# ---- what is refused, with its rule


def _refused(s: SparkSession, sf: str) -> DataFrame:
    shop, docs, times, laid = suite._shop(s, sf), suite._docs(s, sf), suite._times(s, sf), suite._laid(s, sf)
    tx = lambda m, c: Transaction(s, m, c.catalog, lambda: _TX)
    many = Model(Entity("Bag", (A("id", "int64", primary_key=True),), "bag", document="body", value_objects=(ValueObject("items", (A("n", "int64"),), "many"),)))
    bag = Compiler(many, Catalog({"bag": s.createDataFrame([(1, "{}")], "id long, body string")}))
    tries: list[tuple[str, Callable[[], object]]] = [
        ("sort outside the position", lambda: suite._families(s, sf).rows(P.AnyOrder.where().order_by(SortKey("priority")))),
        ("limit of zero", lambda: shop.rows(S.Order.where().limit(0))),
        ("two limits", lambda: S.Order.where().limit(1).limit(2)),
        ("no aggregates", lambda: shop.aggregate(AggregateQuery(S.Order.where(), ()))),
        ("aggregate alias twice", lambda: shop.aggregate(AggregateQuery(S.Order.where(), (Aggregate("count", "n"), Aggregate("count", "n"))))),
        ("unknown aggregate", lambda: shop.aggregate(AggregateQuery(S.Order.where(), (Aggregate("median", "n", "total"),)))),
        ("aggregate of nothing", lambda: shop.aggregate(AggregateQuery(S.Order.where(), (Aggregate("sum", "n"),)))),
        ("aggregate of a stranger", lambda: shop.aggregate(AggregateQuery(S.Order.where(), (Aggregate("sum", "n", "nope"),)))),
        ("valid time omitted", lambda: times.rows(T.Contract.where())),
        ("axis of another entity", lambda: times.rows(T.UserState.where().as_of("valid", suite.MID))),
        ("range turned round", lambda: times.rows(T.UserState.where().as_of_range("transaction", suite.LATE, suite.MID))),
        ("axis chosen twice", lambda: T.UserState.where().as_of("transaction").history("transaction")),
        ("fetch of a value object", lambda: docs.fetch(suite.V.Profile.where().include(Include((("info", ()),))))),
        ("fetch of a stranger", lambda: shop.fetch(S.Order.where().include(Include((("nope", ()),))))),
        ("write of an abstract entity", lambda: Writer(suite.FAMILIES, "Live")),
        ("composite of another type", lambda: tx(suite.DOCS, docs).update("Profile", (1,), {"info": {"balance": "much"}})),
        ("composite that is text", lambda: tx(suite.DOCS, docs).update("Profile", (1,), {"info": "text"})),
        ("composite with a stranger", lambda: tx(suite.DOCS, docs).update_where("Profile", All(), {"info": {"nope": 1}})),
        ("list that is none", lambda: tx(suite.DOCS, docs).update("Profile", (1,), {"orders": {"status": "x"}})),
        ("member of another type", lambda: tx(suite.LAID, laid).update_where("Laid", All(), {"total": "x"})),
        ("required member missing", lambda: tx(suite.LAID, laid).update("Laid", (1,), {"status": None})),
        ("unknown member", lambda: tx(suite.LAID, laid).update("Laid", (1,), {"nope": 1})),
        ("many rows of a history", lambda: tx(suite.TIMES, times).write({"verb": "update", "entity": "UserState", "rows": [{"user": 1, "value": 1.0}, {"user": 2, "value": 1.0}]})),
        ("list by predicate", lambda: tx(many, bag).update_where("Bag", All(), {"items": [{"n": 1}]})),
        ("delete of a history", lambda: tx(suite.TIMES, times).delete("UserState", (1,))),
        ("no window", lambda: tx(suite.TIMES, times).update("Contract", (1,), {"amount": 1.0})),
        ("view that was not fetched", lambda: view(_reads(s, sf).find(S.Region.where()).graph()[0], "nations")),
        ("entity twice", lambda: Model(Entity("X", (A("id", "int64", primary_key=True),)), Entity("X", (A("id", "int64", primary_key=True),)))),
    ]
    rows = []
    for name, attempt in tries:
        try:
            attempt()
            rows.append((name, None))
        except (QueryRejected, WriteRejected, ModelRejected) as e:
            rows.append((name, e.rule))
    return _rows(s, rows, "attempt string, rule string")


_add("rejections", _refused, _values([
    ("sort outside the position", "sort-key-outside-result-position"), ("limit of zero", "limit-not-positive"), ("two limits", "limit-given-twice"),
    ("no aggregates", "aggregates-empty"), ("aggregate alias twice", "aggregate-duplicate-alias"), ("unknown aggregate", "aggregate-unknown-function"),
    ("aggregate of nothing", "aggregate-attribute-missing"), ("aggregate of a stranger", "aggregate-illegal-reference"), ("valid time omitted", "valid-time-selection-missing"),
    ("axis of another entity", "temporal-dimension-undeclared"), ("range turned round", "temporal-range-inverted"), ("axis chosen twice", "temporal-selection-given-twice"),
    ("fetch of a value object", "deep-fetch-value-object-segment"), ("fetch of a stranger", "unknown-relationship"), ("write of an abstract entity", "abstract-write-target"),
    ("composite of another type", "write-value-type-mismatch"), ("composite that is text", "write-value-type-mismatch"), ("composite with a stranger", "unknown-member"),
    ("list that is none", "write-value-type-mismatch"), ("member of another type", "write-value-type-mismatch"), ("required member missing", "write-required-attribute-missing"),
    ("unknown member", "unknown-member"), ("many rows of a history", "temporal-keyed-write-multi-row"), ("list by predicate", "predicate-write-readless-document-many-unsupported"),
    ("delete of a history", "temporal-entity-has-no-delete"), ("no window", "valid-window-missing"), ("view that was not fetched", "view-not-loaded"), ("entity twice", "metamodel-entity-identity-duplicate"),
], "attempt", "rule"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

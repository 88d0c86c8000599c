"""Named queries over the synthetic tables, each with SQL in another formulation.

Models are bound to the tables as they are; histories, families and documents
are derived from them by DataFrame expressions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import All, Nothing
from .functions import documents
from .model import TPCS, TPH, Attribute, Entity, Inheritance, Model, Relationship, SortKey, ValueObject
from .operators.cascade import cascade_delete
from .operators.fetch import exploded
from .operators.keys import Sequence, allocate_max
from .operators.writes import Writer, changed_only, chained
from .plans.compile import Compiler
from .plans.unitofwork import DELETE, INSERT, UPDATE, UnitOfWork
from .query import Aggregate, AggregateQuery, Having, Include, Query
from .sources import generators
from .sources.catalog import Catalog
from .streaming.fold import refold

A, R = Attribute, Relationship
D = dt.datetime


def _pk(name: str, column: str) -> Attribute:
    return A(name, "int64", column, primary_key=True)


SHOP = Model(
    Entity("Region", (_pk("key", "r_regionkey"), A("name", "string", "r_name")), "region",
           (R("nations", "Nation", ("key", "regionKey"), dependent=True, order_by=(SortKey("name", descending=True),)),)),
    Entity("Nation", (_pk("key", "n_nationkey"), A("name", "string", "n_name"), A("regionKey", "int64", "n_regionkey")), "nation",
           (R("region", "Region", reverse_of="nations"), R("customers", "Customer", ("key", "nationKey"), dependent=True))),
    Entity("Customer", (_pk("key", "c_custkey"), A("name", "string", "c_name"), A("nationKey", "int64", "c_nationkey"),
                        A("balance", "float64", "c_acctbal"), A("segment", "string", "c_mktsegment")), "customer",
           (R("nation", "Nation", reverse_of="customers"),
            R("orders", "Order", ("key", "custKey"), dependent=True, order_by=(SortKey("date"), SortKey("key"))))),
    Entity("Order", (_pk("key", "o_orderkey"), A("custKey", "int64", "o_custkey"), A("status", "string", "o_orderstatus"),
                     A("total", "float64", "o_totalprice"), A("date", "timestamp", "o_orderdate"),
                     A("priority", "string", "o_orderpriority", nullable=True)), "orders",
           (R("customer", "Customer", reverse_of="orders"), R("lines", "LineItem", ("key", "orderKey"), dependent=True))),
    Entity("LineItem", (_pk("orderKey", "l_orderkey"), _pk("number", "l_linenumber"), A("partKey", "int64", "l_partkey"),
                        A("quantity", "float64", "l_quantity"), A("price", "float64", "l_extendedprice"),
                        A("flag", "string", "l_returnflag"), A("shipped", "timestamp", "l_shipdate")), "lineitem",
           (R("order", "Order", reverse_of="lines"),)),
)
S = SHOP.ref

FAMILIES = Model(
    Entity("AnyOrder", (_pk("key", "o_orderkey"), A("custKey", "int64", "o_custkey"), A("total", "float64", "o_totalprice")), "orders",
           inheritance=Inheritance("root", strategy=TPH, tag_column="o_orderstatus")),
    Entity("Live", (A("priority", "string", "o_orderpriority"),), inheritance=Inheritance("abstract-subtype", "AnyOrder")),
    Entity("Open", inheritance=Inheritance("concrete-subtype", "Live", tag_value="O")),
    Entity("Pending", inheritance=Inheritance("concrete-subtype", "Live", tag_value="P")),
    Entity("Finished", (A("date", "timestamp", "o_orderdate"),), inheritance=Inheritance("concrete-subtype", "AnyOrder", tag_value="F")),
    Entity("Party", (_pk("id", "id"), A("name", "string"), A("nationKey", "int64"), A("balance", "float64")),
           inheritance=Inheritance("root", strategy=TPCS)),
    Entity("Buyer", (A("segment", "string"),), "buyer", inheritance=Inheritance("concrete-subtype", "Party")),
    Entity("Seller", (A("rating", "int32"),), "seller", inheritance=Inheritance("concrete-subtype", "Party")),
    Entity("Land", (_pk("key", "n_nationkey"), A("name", "string", "n_name")), "nation",
           (R("parties", "Party", ("key", "nationKey")),)),
    Entity("Client", (_pk("key", "c_custkey"), A("name", "string", "c_name")), "customer",
           (R("orders", "AnyOrder", ("key", "custKey")),)),
)
P = FAMILIES.ref

TIMES = Model(
    Entity("UserState", (_pk("user", "user_id"), A("kind", "string", "event_type"), A("value", "float64", "value")), "user_state",
           temporality="transaction-time"),
    Entity("Contract", (_pk("key", "key"), A("customer", "int64"), A("amount", "float64")), "contract", temporality="bitemporal"),
    Entity("Holder", (_pk("key", "c_custkey"), A("name", "string", "c_name")), "holder",
           (R("contracts", "Contract", ("key", "customer")),)),
    Entity("Account", (_pk("key", "c_custkey"), A("balance", "float64", "c_acctbal"),
                       A("version", "int32", optimistic_locking=True)), "account"),
    Entity("Ledger", (_pk("key", "user_id"), A("value", "float64", "value")), "ledger",
           (R("entries", "UserState", ("key", "user")),), temporality="transaction-time"),
)
T = TIMES.ref

DOCS = Model(
    Entity("Profile", (_pk("key", "c_custkey"), A("name", "string", "c_name")), "profile", value_objects=(
        ValueObject("info", (A("segment", "string", nullable=True), A("nation", "int64", nullable=True), A("balance", "float64", nullable=True))),
        ValueObject("orders", (A("status", "string", nullable=True), A("priority", "string", nullable=True),
                               A("total", "float64", nullable=True), A("key", "int64", nullable=True)), "many"),
    )),
)
V = DOCS.ref

MID, LATE = D(1995, 6, 1), D(1997, 1, 1)
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def base(spark: SparkSession, sf: str) -> Catalog:
    return Catalog.parquet(spark, sf, TABLES)


def _shop(spark: SparkSession, sf: str) -> Compiler:
    c = base(spark, sf)
    # the tables hold no nulls: one priority is made null for the tests of nulls
    o = lambda: c.frame("orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return Compiler(SHOP, c.with_table("orders", o))


ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"


def _families(spark: SparkSession, sf: str) -> Compiler:
    c = base(spark, sf)
    buyer = lambda: c.frame("customer").selectExpr("c_custkey id", "c_name name", "c_nationkey nation_key", "c_acctbal balance", "c_mktsegment segment")
    seller = lambda: c.frame("supplier").selectExpr("s_suppkey id", "s_name name", "s_nationkey nation_key", "s_acctbal balance", "cast(s_suppkey % 5 as int) rating")
    return Compiler(FAMILIES, c.with_table("buyer", buyer).with_table("seller", seller))


BUYER = "(SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_key, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS rating, 'Buyer' AS familyVariant FROM customer)"
SELLER = "(SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation_key, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment, CAST(s_suppkey % 5 AS INTEGER) AS rating, 'Seller' AS familyVariant FROM supplier)"
PARTY = f"(SELECT * FROM {BUYER} UNION ALL SELECT * FROM {SELLER})"
KIND = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending' ELSE 'Finished' END AS familyVariant"


def user_states(c: Catalog) -> DataFrame:
    e = c.frame("events").select("user_id", "event_type", "value", "ts")
    return chained(e, ["user_id"], "ts").drop("ts")


STATES = "(SELECT user_id, event_type, value, ts AS in_z, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '9999-12-31 23:59:59.999999') AS out_z FROM events)"


def contracts(c: Catalog) -> DataFrame:
    """Per order: valid from its date; thirty days later a correction of days 10 to 20 doubles the amount."""
    day = lambda n: F.col("o_orderdate") + F.expr(f"interval {n} days")
    inf = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
    d0, d10, d20, d30 = F.col("o_orderdate"), day(10), day(20), day(30)
    row = lambda m, a, b, i, o: F.struct((F.col("o_totalprice") * m).alias("amount"), a.alias("from_z"), b.alias("thru_z"), i.alias("in_z"), o.alias("out_z"))
    rows = F.array(row(1, d0, inf, d0, d30), row(1, d0, d10, d30, inf), row(2, d10, d20, d30, inf), row(1, d20, inf, d30, inf))
    return c.frame("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.inline(rows))


_INF = "TIMESTAMP '9999-12-31 23:59:59.999999'"
CONTRACTS = "(" + " UNION ALL ".join(
    f"SELECT o_orderkey AS key, o_custkey AS customer, {m} * o_totalprice AS amount, {a} AS from_z, {b} AS thru_z, {i} AS in_z, {o} AS out_z FROM orders"
    for m, a, b, i, o in (
        (1, "o_orderdate", _INF, "o_orderdate", "o_orderdate + INTERVAL 30 DAY"),
        (1, "o_orderdate", "o_orderdate + INTERVAL 10 DAY", "o_orderdate + INTERVAL 30 DAY", _INF),
        (2, "o_orderdate + INTERVAL 10 DAY", "o_orderdate + INTERVAL 20 DAY", "o_orderdate + INTERVAL 30 DAY", _INF),
        (1, "o_orderdate + INTERVAL 20 DAY", _INF, "o_orderdate + INTERVAL 30 DAY", _INF),
    )
) + ")"


def _times(spark: SparkSession, sf: str) -> Compiler:
    c = base(spark, sf)
    account = lambda: c.frame("customer").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    ledger = lambda: user_states(c).select("user_id", "value", "in_z", "out_z")
    return Compiler(
        TIMES,
        c.with_table("user_state", lambda: user_states(c)).with_table("contract", lambda: contracts(c))
        .with_table("account", account).with_table("ledger", ledger)
        .with_table("holder", lambda: c.frame("customer").select("c_custkey", "c_name")),
    )


def _docs(spark: SparkSession, sf: str) -> Compiler:
    c = base(spark, sf)

    def profile() -> DataFrame:
        item = F.struct(F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("key"))
        per = c.frame("orders").where("o_custkey % 3 <> 0").groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("orders"))
        info = F.to_json(F.struct(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("x").alias("zip")))
        info = F.when(F.col("c_custkey") % 7 != 0, info)
        customer = c.frame("customer")
        return customer.join(per, customer["c_custkey"] == per["o_custkey"], "left").select("c_custkey", "c_name", info.alias("info"), "orders")

    return Compiler(DOCS, c.with_table("profile", profile))


INFO = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN nullif(c_mktsegment, 'BUILDING') END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, c_custkey % 7 <> 0 AS present FROM customer)"
ITEMS = "(SELECT o_custkey, o_orderkey AS key, o_orderstatus AS status, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_totalprice AS total FROM orders WHERE o_custkey % 3 <> 0)"

Built = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Built] = {}
_SQL: dict[str, str] = {}


def _add(name: str, build: Built, sql: str) -> None:
    _QUERIES[name], _SQL[name] = build, sql


def _orders(name: str, predicate, where: str) -> None:
    """A predicate on orders."""
    _add(name, lambda s, sf: _shop(s, sf).rows(S.Order.where(predicate)), f"SELECT * FROM {ORDERS} o WHERE {where}")


def _customers(name: str, predicate, where: str) -> None:
    _add(name, lambda s, sf: _shop(s, sf).rows(S.Customer.where(predicate)), f"SELECT * FROM customer WHERE {where}")


def _profiles(name: str, predicate, where: str) -> None:
    sql = f"SELECT c_custkey, c_name FROM {INFO} p WHERE {where}"
    _add(name, lambda s, sf: _docs(s, sf).rows(V.Profile.where(predicate), documents=False), sql)


# ---- predicates

_orders("pred_all", All(), "true")
_orders("pred_none", Nothing(), "false")
_orders("pred_eq", S.Order.status == "O", "o_orderstatus IN ('O')")
_orders("pred_not_eq", S.Order.priority != "1-URGENT", "NOT (o_orderpriority = '1-URGENT') AND o_orderpriority IS NOT NULL")
_orders("pred_gt", S.Order.total > 250000.0, "NOT o_totalprice <= 250000")
_orders("pred_gte", S.Order.date >= LATE, "NOT o_orderdate < TIMESTAMP '1997-01-01'")
_orders("pred_lt", S.Order.total < 50000.0, "NOT o_totalprice >= 50000")
_orders("pred_lte", S.Order.key <= 1000, "NOT o_orderkey > 1000")
_orders("pred_between", S.Order.total.between(100000.0, 120000.0), "o_totalprice >= 100000 AND o_totalprice <= 120000")
_orders("pred_is_null", S.Order.priority.is_null(), "coalesce(o_orderpriority, '') = ''")
_orders("pred_is_not_null", S.Order.priority.is_not_null(), "coalesce(o_orderpriority, '') <> ''")
_orders("pred_like", S.Order.priority.like("%-_IG%"), "regexp_matches(o_orderpriority, '-.IG')")
_orders("pred_not_like", S.Order.priority.not_like("%HIGH%"), "strpos(o_orderpriority, 'HIGH') = 0")
_orders("pred_starts_with", S.Order.priority.starts_with("5-"), "substr(o_orderpriority, 1, 2) = '5-'")
_orders("pred_ends_with", S.Order.priority.ends_with("LOW"), "right(o_orderpriority, 3) = 'LOW'")
_orders("pred_contains_escape", S.Order.priority.contains("%") | S.Order.priority.contains("-U"), "strpos(o_orderpriority, '%') > 0 OR strpos(o_orderpriority, '-U') > 0")
_orders("pred_like_ci", S.Order.priority.like("%urgent", ignore_case=True), "o_orderpriority ILIKE '%urgent'")
_orders("pred_in", S.Order.priority.in_(["1-URGENT", "2-HIGH"]), "o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH'")
_orders("pred_not_in", S.Order.priority.not_in(["1-URGENT", "2-HIGH"]), "o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH'")
_orders("pred_and", (S.Order.status == "F") & (S.Order.total > 200000.0), "CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 200000 ELSE false END")
_orders("pred_or", (S.Order.status == "P") | S.Order.priority.is_null(), "o_orderstatus = 'P' OR o_orderpriority IS NULL")
_orders("pred_not", ~(S.Order.priority == "5-LOW"), "o_orderpriority <> '5-LOW'")
_orders("pred_group_precedence", ((S.Order.status == "O") | (S.Order.status == "P")).grouped() & (S.Order.total < 90000.0), "o_orderstatus <> 'F' AND o_totalprice < 90000")
_orders("pred_not_compound", ~((S.Order.status == "O") & (S.Order.total > 100000.0)), "o_orderstatus <> 'O' OR o_totalprice <= 100000")
_add(
    "pred_narrow",
    lambda s, sf: _families(s, sf).rows(P.AnyOrder.where(P.Live.narrowed(P.Live.priority == "1-URGENT") | (P.AnyOrder.total > 300000.0))),
    f"SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderpriority, o_orderdate, {KIND} FROM orders WHERE (o_orderstatus IN ('O','P') AND o_orderpriority = '1-URGENT') OR o_totalprice > 300000",
)

# ---- navigation

_customers("nav_exists", S.Customer.orders.exists(), "c_custkey IN (SELECT o_custkey FROM orders)")
_customers("nav_exists_where", S.Customer.orders.exists(S.Order.total > 400000.0), "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_customers("nav_not_exists", S.Customer.orders.not_exists(S.Order.status == "P"), "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_orders("nav_to_one", S.Order.customer.exists(S.Customer.segment == "BUILDING"), "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_customers("nav_multi_hop", S.Customer.orders.exists(S.Order.lines.exists(S.LineItem.quantity >= 50.0)), "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))")
_customers("nav_not_multi_hop", S.Customer.orders.not_exists(S.Order.lines.exists((S.LineItem.flag == "R") & (S.LineItem.quantity > 45.0))), "c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45)")
_customers("nav_or_position", S.Customer.orders.exists(S.Order.total > 450000.0) | (S.Customer.balance < -500.0), "c_acctbal < -500 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
_customers("nav_not_position", ~(S.Customer.orders.exists(S.Order.status == "P") | (S.Customer.balance > 5000.0)), "c_acctbal <= 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_customers("nav_chain", S.Customer.nation.region.exists(S.Region.name == "ASIA"), "c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
_add(
    "nav_poly_tph",
    lambda s, sf: _families(s, sf).rows(P.Client.where(P.Client.orders.narrow("Finished").exists(P.AnyOrder.total > 300000.0))),
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)",
)
_add(
    "nav_poly_tpcs",
    lambda s, sf: _families(s, sf).rows(P.Land.where(P.Land.parties.exists(P.Party.balance < -900.0))),
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -900)",
)
_add(
    "nav_temporal_hop",
    lambda s, sf: _times(s, sf).rows(T.Holder.where(T.Holder.contracts.exists(T.Contract.amount > 400000.0))),
    f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT customer FROM {CONTRACTS} WHERE amount > 400000 AND thru_z = {_INF} AND out_z = {_INF})",
)

# ---- order and limit

for _nulls in (True, False):
    for _down in (False, True):
        _key = SortKey("priority", _down, _nulls)
        _name = f"order_nulls_{'desc' if _down else 'asc'}_{'first' if _nulls else 'last'}"
        _add(
            _name,
            lambda s, sf, k=_key: _shop(s, sf).rows(S.Order.where(S.Order.total > 100000.0).order_by(k, SortKey("key")).limit(500)),
            f"SELECT * FROM {ORDERS} o WHERE o_totalprice > 100000 ORDER BY o_orderpriority {'DESC' if _down else 'ASC'} NULLS {'FIRST' if _nulls else 'LAST'}, o_orderkey LIMIT 500",
        )
_add(
    "order_limit_topk",
    lambda s, sf: _shop(s, sf).rows(S.Order.where().order_by(S.Order.total.desc(), S.Order.key.asc()).limit(25)),
    f"SELECT * FROM {ORDERS} o ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)

# ---- transaction time

_state = "SELECT user_id, event_type, value, in_z, out_z FROM " + STATES + " s"


def _tt(name: str, query: Callable[[], Query], where: str) -> None:
    _add(name, lambda s, sf: _times(s, sf).rows(query()), f"{_state} WHERE {where}")


TT_AT, TT_END = D(2024, 1, 10), D(2024, 1, 20)
_tt("tt_latest", lambda: T.UserState.where(), f"out_z = {_INF}")
_tt("tt_as_of", lambda: T.UserState.where().as_of("transaction", TT_AT), "in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10'")
_tt("tt_range", lambda: T.UserState.where(T.UserState.value > 50.0).as_of_range("transaction", TT_AT, TT_END), "in_z < TIMESTAMP '2024-01-20' AND out_z > TIMESTAMP '2024-01-10' AND value > 50")
_tt("tt_history", lambda: T.UserState.where(T.UserState.kind == "click").history("transaction"), "event_type = 'click'")
_add(
    "tt_boundary",
    lambda s, sf: _boundary(s, sf),
    f"SELECT a.user_id, a.value, count(*) AS n FROM {STATES} a JOIN {STATES} b ON a.user_id = b.user_id AND b.in_z <= a.in_z AND b.out_z > a.in_z GROUP BY ALL",
)


def _boundary(s: SparkSession, sf: str) -> DataFrame:
    """Exactly one milestone holds at each milestone's start."""
    from .operators.temporal import holds

    rows = _times(s, sf).rows(T.UserState.where().history("transaction"))
    at = rows.select("user_id", "value", F.col("in_z").alias("at"))
    b = rows.select(F.col("user_id").alias("u"), F.col("in_z").alias("i"), F.col("out_z").alias("o"))
    return at.join(b, (at["user_id"] == b["u"]) & holds(b["i"], b["o"], at["at"])).groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("n"))


_add(
    "tt_point_lookup",
    lambda s, sf: _times(s, sf).aggregate(AggregateQuery(T.UserState.where().as_of("transaction", TT_AT), (Aggregate("count", "n"), Aggregate("max", "top", "value")), ("kind",))),
    f"SELECT event_type AS kind, count(*) AS n, max(value) AS top FROM {STATES} s WHERE in_z <= TIMESTAMP '2024-01-10' AND out_z > TIMESTAMP '2024-01-10' GROUP BY 1",
)

# ---- both axes

_PAST = D(1995, 6, 20)


def _bt(name: str, query: Callable[[], Query], where: str) -> None:
    _add(name, lambda s, sf: _times(s, sf).rows(query()), f"SELECT key, customer, amount, from_z, thru_z, in_z, out_z FROM {CONTRACTS} c WHERE {where}")


_v, _t = "from_z <= TIMESTAMP '1995-06-20' AND thru_z > TIMESTAMP '1995-06-20'", "in_z <= TIMESTAMP '1995-06-20' AND out_z > TIMESTAMP '1995-06-20'"
_bt("bt_latest_latest", lambda: T.Contract.where().as_of("valid"), f"thru_z = {_INF} AND out_z = {_INF}")
_bt("bt_past_latest", lambda: T.Contract.where().as_of("valid", _PAST), f"{_v} AND out_z = {_INF}")
_bt("bt_latest_past", lambda: T.Contract.where().as_of("valid").as_of("transaction", _PAST), f"thru_z = {_INF} AND {_t}")
_bt("bt_past_past", lambda: T.Contract.where().as_of("valid", _PAST).as_of("transaction", _PAST), f"{_v} AND {_t}")
_bt("bt_history", lambda: T.Contract.where(T.Contract.amount > 300000.0).history("valid").history("transaction"), "amount > 300000")
_bt("bt_range", lambda: T.Contract.where().as_of_range("valid", _PAST, D(1995, 7, 1)).as_of("transaction"), f"from_z < TIMESTAMP '1995-07-01' AND thru_z > TIMESTAMP '1995-06-20' AND out_z = {_INF}")

# ---- families

_tph = f"SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderpriority, o_orderdate, {KIND} FROM orders"
_add("fam_tph_root", lambda s, sf: _families(s, sf).rows(P.AnyOrder.where(P.AnyOrder.total > 200000.0)), f"{_tph} WHERE o_totalprice > 200000")
_add("fam_tph_subtype", lambda s, sf: _families(s, sf).rows(P.Live.where(P.Live.priority == "5-LOW")), f"SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderpriority, {KIND} FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '5-LOW'")
_add("fam_tph_concrete", lambda s, sf: _families(s, sf).rows(P.Finished.where(P.Finished.date < MID)), "SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-06-01'")
_add("fam_tph_narrow", lambda s, sf: _families(s, sf).rows(P.AnyOrder.where().narrow("Open", "Finished")), f"{_tph} WHERE o_orderstatus <> 'P'")
_add("fam_tph_branch_or", lambda s, sf: _families(s, sf).rows(P.AnyOrder.where(P.Finished.narrowed(P.Finished.date >= LATE) | P.Pending.narrowed())), f"{_tph} WHERE (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01') OR o_orderstatus = 'P'")
_party = "id, name, nation_key, balance, segment, rating, familyVariant"
_add("fam_tpcs_root", lambda s, sf: _families(s, sf).rows(P.Party.where(P.Party.balance > 0.0)), f"SELECT {_party} FROM {PARTY} WHERE balance > 0")
_add("fam_tpcs_narrow", lambda s, sf: _families(s, sf).rows(P.Party.where(P.Party.balance < 100.0).narrow("Seller")), "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation_key, s_acctbal AS balance, CAST(s_suppkey % 5 AS INTEGER) AS rating, 'Seller' AS familyVariant FROM supplier WHERE s_acctbal < 100")
_add("fam_tpcs_concrete", lambda s, sf: _families(s, sf).rows(P.Buyer.where(P.Buyer.segment == "MACHINERY")), "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_key, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'MACHINERY'")
_add("fam_tpcs_branch_or", lambda s, sf: _families(s, sf).rows(P.Party.where(P.Buyer.narrowed(P.Buyer.segment == "BUILDING") | P.Seller.narrowed(P.Seller.rating >= 3))), f"SELECT {_party} FROM {PARTY} WHERE segment = 'BUILDING' OR rating >= 3")

# ---- value objects

_i, _o = V.Profile.info, V.Profile.orders
_in = "c_custkey IN (SELECT o_custkey FROM " + ITEMS + " i WHERE {})"
_profiles("vo_eq", _i.segment == "MACHINERY", "segment = 'MACHINERY'")
_profiles("vo_not_eq", _i.segment != "MACHINERY", "segment <> 'MACHINERY'")
_profiles("vo_gt", _i.balance > 5000.0, "balance > 5000")
_profiles("vo_gte", _i.nation >= 20, "nation >= 20")
_profiles("vo_lt", _i.balance < 0.0, "balance < 0")
_profiles("vo_lte", _i.nation <= 3, "nation <= 3")
_profiles("vo_between", _i.nation.between(5, 9), "nation BETWEEN 5 AND 9")
_profiles("vo_in", _i.segment.in_(["MACHINERY", "FURNITURE"]), "segment IN ('MACHINERY', 'FURNITURE')")
_profiles("vo_not_in", _i.segment.not_in(["MACHINERY", "FURNITURE"]), "segment NOT IN ('MACHINERY', 'FURNITURE')")
_profiles("vo_like", _i.segment.like("%HOLD%"), "segment LIKE '%HOLD%'")
_profiles("vo_not_like", _i.segment.not_like("M%"), "segment NOT LIKE 'M%'")
_profiles("vo_starts_with", _i.segment.starts_with("AUTO"), "starts_with(segment, 'AUTO')")
_profiles("vo_ends_with", _i.segment.ends_with("ERY"), "suffix(segment, 'ERY')")
_profiles("vo_contains", _i.segment.contains("urn", ignore_case=True), "contains(lower(segment), 'urn')")
_profiles("vo_is_null", _i.segment.is_null(), "segment IS NULL")
_profiles("vo_is_not_null", _i.segment.is_not_null(), "segment IS NOT NULL")
_profiles("vo_any_element", _o.status == "P", _in.format("status = 'P'"))
_profiles("vo_any_element_and", (_o.status == "P") & (_o.total > 300000.0), _in.format("status = 'P'") + " AND " + _in.format("total > 300000"))
_profiles("vo_any_element_not_in", _o.priority.not_in(["1-URGENT", "2-HIGH", "3-MEDIUM"]), _in.format("priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"))
_profiles("vo_exists_one", V.Profile.info.exists(), "present")
_profiles("vo_exists", _o.exists(), _in.format("true"))
_profiles("vo_not_exists", _o.not_exists(), "NOT " + _in.format("true"))
_profiles("vo_exists_same_element", _o.exists(lambda e: (e.status == "P") & (e.total > 200000.0)), _in.format("status = 'P' AND total > 200000"))
_profiles("vo_not_exists_where", _o.not_exists(lambda e: (e.status == "F") & (e.total > 300000.0)), "NOT " + _in.format("status = 'F' AND total > 300000"))

# ---- deep fetch (nested results are flattened to be compared)

_add(
    "fetch_to_one",
    lambda s, sf: _shop(s, sf).fetch(S.Order.where(S.Order.total > 300000.0).include(S.Order.customer)).select("o_orderkey", "customer.c_custkey", "customer.c_name"),
    "SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000",
)
_add(
    "fetch_to_many",
    lambda s, sf: exploded(_shop(s, sf).fetch(S.Customer.where(S.Customer.balance > 5000.0).include(S.Customer.orders)), "orders", "c_custkey").select("c_custkey", "o_orderkey", "o_totalprice"),
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000",
)
_add(
    "fetch_to_many_empty",
    lambda s, sf: _empty_views(s, sf),
    "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation",
)


def _empty_views(s: SparkSession, sf: str) -> DataFrame:
    return _shop(s, sf).fetch(S.Nation.where().include(S.Nation.customers)).select("n_nationkey", F.size("customers").cast("long").alias("n"))


_add(
    "fetch_multi_hop",
    lambda s, sf: exploded(exploded(_shop(s, sf).fetch(S.Customer.where(S.Customer.segment == "BUILDING").include(S.Customer.orders.lines)), "orders", "c_custkey"), "lines", "c_custkey", "o_orderkey").groupBy("c_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")),
    "SELECT c_custkey, o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2",
)
_add(
    "fetch_two_paths",
    lambda s, sf: _shop(s, sf).fetch(S.Customer.where().include(S.Customer.orders, S.Customer.nation.region)).select("c_custkey", F.size("orders").cast("long").alias("n"), F.col("nation.region.r_name").alias("region")),
    "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
_add(
    "fetch_ordered",
    lambda s, sf: _shop(s, sf).fetch(S.Region.where().include(S.Region.nations)).select("r_name", F.posexplode("nations").alias("pos", "x")).select("r_name", F.col("pos").cast("long").alias("pos"), "x.n_name"),
    "SELECT r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC, n_nationkey) - 1 AS pos, n_name FROM region JOIN nation ON n_regionkey = r_regionkey",
)
_add(
    "fetch_back_reference",
    lambda s, sf: exploded(_shop(s, sf).fetch(S.Region.where().include(S.Region.nations.region)), "nations", "r_regionkey").select("r_regionkey", "n_nationkey", F.col("region.r_regionkey").alias("back")),
    "SELECT r_regionkey, n_nationkey, n_regionkey AS back FROM region JOIN nation ON n_regionkey = r_regionkey",
)
_add(
    "fetch_limited_roots",
    lambda s, sf: exploded(_shop(s, sf).fetch(S.Customer.where().order_by(S.Customer.balance.desc(), S.Customer.key.asc()).limit(10).include(S.Customer.orders)), "orders", "c_custkey").select("c_custkey", "o_orderkey"),
    "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey",
)
_add(
    "fetch_narrowed",
    lambda s, sf: exploded(_families(s, sf).fetch(P.Client.where().include(P.Client.orders.narrow("Live"))), "orders[Live]", "c_custkey").select("c_custkey", "o_orderkey", "familyVariant"),
    f"SELECT o_custkey AS c_custkey, o_orderkey, {KIND} FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer)",
)
_add(
    "fetch_poly_tpcs",
    lambda s, sf: exploded(_families(s, sf).fetch(P.Land.where().include(P.Land.parties)), "parties", "n_nationkey").select("n_nationkey", "id", "familyVariant", "rating"),
    f"SELECT nation_key AS n_nationkey, id, familyVariant, rating FROM {PARTY} WHERE nation_key IN (SELECT n_nationkey FROM nation)",
)
GUARDED = Model(
    *[e for e in FAMILIES if e.name in ("Live", "Open", "Pending", "Finished")],
    Entity("AnyOrder", FAMILIES.entity("AnyOrder").attributes, "orders", (R("lines", "Line", ("key", "order")),), inheritance=FAMILIES.entity("AnyOrder").inheritance),
    Entity("Line", (_pk("order", "l_orderkey"), _pk("number", "l_linenumber"), A("quantity", "float64", "l_quantity")), "lineitem"),
)
_add(
    "fetch_guarded",
    lambda s, sf: Compiler(GUARDED, base(s, sf)).fetch(GUARDED.ref.AnyOrder.where().include(Include((("lines", ()),), ("Finished",)))).select("o_orderkey", F.when(F.col("lines").isNotNull(), F.size("lines")).cast("long").alias("n")),
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n FROM orders",
)
_add(
    "fetch_pinned",
    lambda s, sf: exploded(_times(s, sf).fetch(T.Ledger.where().as_of("transaction", TT_AT).include(T.Ledger.entries)), "entries", "user_id", "value").toDF("user_id", "value", "user2", "kind", "value2", "i", "o").select("user_id", "value", "kind", "value2"),
    f"SELECT a.user_id, a.value, b.event_type AS kind, b.value AS value2 FROM {STATES} a JOIN {STATES} b ON a.user_id = b.user_id WHERE a.in_z <= TIMESTAMP '2024-01-10' AND a.out_z > TIMESTAMP '2024-01-10' AND b.in_z <= TIMESTAMP '2024-01-10' AND b.out_z > TIMESTAMP '2024-01-10'",
)
_add(
    "fetch_history_edges",
    lambda s, sf: _times(s, sf).fetch(T.Ledger.where().history("transaction").include(T.Ledger.entries)).select("user_id", F.col("edge.transaction").alias("edge"), F.size("entries").cast("long").alias("n"), F.col("entries")[0]["event_type"].alias("kind")),
    "SELECT user_id, ts AS edge, CAST(1 AS BIGINT) AS n, event_type AS kind FROM events",
)
_add(
    "find_history",
    lambda s, sf: _times(s, sf).history(T.UserState.where().as_of_range("transaction", TT_AT, TT_END)).select("user_id", F.col("edge.transaction").alias("edge"), F.col("pin.transaction").alias("pin")),
    f"SELECT user_id, in_z AS edge, CAST(NULL AS TIMESTAMP) AS pin FROM {STATES} s WHERE in_z < TIMESTAMP '2024-01-20' AND out_z > TIMESTAMP '2024-01-10'",
)

# ---- aggregation

_all = (
    Aggregate("count", "n"), Aggregate("count", "n_priority", "priority"), Aggregate("sum", "s", "key"), Aggregate("avg", "a", "total"),
    Aggregate("min", "lo", "total"), Aggregate("max", "hi", "total"), Aggregate("stdDevSample", "ss", "total"),
    Aggregate("stdDevPop", "sp", "total"), Aggregate("varianceSample", "vs", "total"), Aggregate("variancePop", "vp", "total"),
)


def _rounded(df: DataFrame) -> DataFrame:
    """Floating sums depend on their order: compared to seven digits."""
    kinds = dict(df.dtypes)
    return df.select(*[F.format_string("%.6e", F.col(c)).alias(c) if kinds[c] == "double" and c not in ("lo", "hi") else F.col(c) for c in df.columns])


def _digits(x: str, alias: str) -> str:
    return f"printf('%.6e', {x}) AS {alias}"


_aggs = (
    "count(*) AS n, count(o_orderpriority) AS n_priority, CAST(sum(o_orderkey) AS BIGINT) AS s, " + _digits("avg(o_totalprice)", "a") + ", min(o_totalprice) AS lo, max(o_totalprice) AS hi, "
    + _digits("stddev_samp(o_totalprice)", "ss") + ", " + _digits("stddev_pop(o_totalprice)", "sp") + ", " + _digits("var_samp(o_totalprice)", "vs") + ", " + _digits("var_pop(o_totalprice)", "vp")
)
_add("agg_ungrouped", lambda s, sf: _rounded(_shop(s, sf).aggregate(AggregateQuery(S.Order.where(S.Order.status == "O"), _all))), f"SELECT {_aggs} FROM {ORDERS} o WHERE o_orderstatus = 'O'")
_add("agg_each_function", lambda s, sf: _rounded(_shop(s, sf).aggregate(AggregateQuery(S.Order.where(), _all, ("status", "priority")))), f"SELECT o_orderstatus AS status, o_orderpriority AS priority, {_aggs} FROM {ORDERS} o GROUP BY 1, 2")
_add("agg_grouped", lambda s, sf: _shop(s, sf).aggregate(AggregateQuery(S.LineItem.where(), (Aggregate("count", "n"), Aggregate("sum", "q", "quantity")), ("flag",))), "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
_add("agg_having", lambda s, sf: _shop(s, sf).aggregate(AggregateQuery(S.Order.where(), (Aggregate("count", "n"), Aggregate("max", "top", "total")), ("custKey",), (Having("n", "greaterThanEquals", 15), Having("top", "isNotNull")))), "SELECT * FROM (SELECT o_custkey AS custKey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) WHERE n >= 15")
_add("agg_order_limit", lambda s, sf: _shop(s, sf).aggregate(AggregateQuery(S.Order.where(), (Aggregate("count", "n"),), ("custKey",), (), (SortKey("n", True), SortKey("custKey")), 20)), "SELECT o_custkey AS custKey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, custKey LIMIT 20")
_add("agg_empty", lambda s, sf: _shop(s, sf).aggregate(AggregateQuery(S.Order.where(Nothing()), (Aggregate("count", "n"), Aggregate("sum", "s", "key"), Aggregate("stdDevSample", "d", "total")))), "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS d")
_add("agg_over_navigation", lambda s, sf: _shop(s, sf).aggregate(AggregateQuery(S.Customer.where(S.Customer.orders.exists(S.Order.status == "P")), (Aggregate("count", "n"), Aggregate("min", "lo", "balance")), ("segment",))), "SELECT c_mktsegment AS segment, count(*) AS n, min(c_acctbal) AS lo FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")

# ---- writes: whole new tables

_ACC = "(SELECT c_custkey, c_acctbal, CAST(1 AS INTEGER) AS version FROM customer)"


def _account(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Writer]:
    c = _times(s, sf)
    return c.catalog.frame("account"), c.catalog.frame("customer"), Writer(TIMES, "Account")


def _write(name: str, verb: Callable[[DataFrame, DataFrame, Writer], DataFrame], sql: str) -> None:
    _add(name, lambda s, sf: verb(*_account(s, sf)), sql)


_write("write_insert", lambda t, c, w: w.insert(t, c.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(0.5).alias("c_acctbal"))),
       f"SELECT * FROM {_ACC} UNION ALL SELECT c_custkey + 1000000, 0.5, 1 FROM customer WHERE c_mktsegment = 'BUILDING'")
_write("write_update", lambda t, c, w: w.update(t, c.where("c_nationkey = 3").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))),
       "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer")
_write("write_delete", lambda t, c, w: w.delete(t, c.where("c_nationkey > 20").select("c_custkey")), f"SELECT * FROM {_ACC} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 20)")
_write("write_predicate_update", lambda t, c, w: w.update_where(t, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}), "SELECT c_custkey, greatest(c_acctbal, 0) AS c_acctbal, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer")
_write("write_predicate_delete", lambda t, c, w: w.delete_where(t, F.col("c_acctbal") < 0), f"SELECT * FROM {_ACC} WHERE c_acctbal >= 0")
_write("write_version_gate", lambda t, c, w: w.update(t, c.where("c_acctbal > 0").select("c_custkey", F.lit(7.0).alias("c_acctbal"), F.when(F.col("c_nationkey") < 12, 1).otherwise(9).alias("observed_version"))),
       "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey < 12 THEN 7.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_acctbal > 0 AND c_nationkey < 12 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer")
_write("write_conflicts", lambda t, c, w: w.unmatched(t, c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit(7.0).alias("c_acctbal"))).select("c_custkey"), "SELECT c_custkey * 2 AS c_custkey FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
_write("write_no_op", lambda t, c, w: changed_only(t, c.select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("c_acctbal")), ["c_custkey"]), "SELECT c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal < 0")


def _coalesced(s: SparkSession, sf: str) -> DataFrame:
    c = _times(s, sf)
    u = UnitOfWork(s, TIMES, c.catalog)
    u.add(INSERT, "Account", (-1,), {"balance": 1.0})
    u.add(UPDATE, "Account", (-1,), {"balance": 2.0})
    u.add(INSERT, "Account", (-2,), {"balance": 1.0})
    u.add(DELETE, "Account", (-2,))
    u.add(UPDATE, "Account", (5,), {"balance": 3.0})
    u.add(UPDATE, "Account", (5,), {"balance": 4.0})
    u.add(UPDATE, "Account", (6,), {"balance": 4.0})
    u.add(DELETE, "Account", (6,))
    return u.apply(lambda: MID)["account"]


_add("write_coalesce", _coalesced, "SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 4.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey = 5 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer WHERE c_custkey <> 6 UNION ALL SELECT -1, 2.0, 1")


def _cascade(s: SparkSession, sf: str) -> DataFrame:
    c = base(s, sf)
    gone = c.frame("nation").where("n_regionkey = 2").select("n_nationkey")
    left = cascade_delete(SHOP, c, "Nation", gone)
    return left["nation"].select(F.lit("nation").alias("t"), F.col("n_nationkey").alias("k")).union(left["customer"].select(F.lit("customer"), "c_custkey")).union(left["orders"].select(F.lit("orders"), "o_orderkey")).union(left["lineitem"].groupBy("l_orderkey").agg(F.lit(1)).select(F.lit("lineitem"), "l_orderkey"))


_add("write_cascade", _cascade, "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)) SELECT 'nation' AS t, n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT * FROM n) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT * FROM c) UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o) UNION ALL SELECT DISTINCT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o)")

_TX = D(2030, 1, 1)
_txs = "TIMESTAMP '2030-01-01'"


def _tt_write(name: str, verb: Callable[[DataFrame, Writer], DataFrame], sql: str) -> None:
    def build(s: SparkSession, sf: str) -> DataFrame:
        return verb(_times(s, sf).catalog.frame("user_state"), Writer(TIMES, "UserState"))

    _add(name, build, sql)


_ST = "SELECT user_id, event_type, value, in_z, out_z FROM " + STATES + " s"
_tt_write("tt_insert", lambda t, w: w.tt_insert(t, t.groupBy("user_id").agg(F.lit("new").alias("event_type"), F.lit(1.0).alias("value")).withColumn("user_id", F.col("user_id") + 100000), _TX),
          f"{_ST} UNION ALL SELECT DISTINCT user_id + 100000, 'new', 1.0, {_txs}, {_INF} FROM events")
_tt_write("tt_update", lambda t, w: w.tt_update(t, t.where("value > 60").select("user_id").distinct().withColumn("value", F.lit(-1.0)), _TX),
          f"SELECT user_id, event_type, value, in_z, CASE WHEN out_z = {_INF} AND user_id IN (SELECT user_id FROM events WHERE value > 60) THEN {_txs} ELSE out_z END AS out_z FROM {STATES} s UNION ALL SELECT user_id, event_type, -1.0, {_txs}, {_INF} FROM {STATES} s WHERE out_z = {_INF} AND user_id IN (SELECT user_id FROM events WHERE value > 60)")
_tt_write("tt_terminate", lambda t, w: w.tt_terminate(t, t.where("value < 30").select("user_id").distinct(), _TX),
          f"SELECT user_id, event_type, value, in_z, CASE WHEN out_z = {_INF} AND user_id IN (SELECT user_id FROM events WHERE value < 30) THEN {_txs} ELSE out_z END AS out_z FROM {STATES} s")
_tt_write("tt_update_where", lambda t, w: w.tt_update_where(t, F.col("value") > 90, {"value": F.lit(90.0)}, _TX),
          f"SELECT user_id, event_type, value, in_z, CASE WHEN out_z = {_INF} AND value > 90 THEN {_txs} ELSE out_z END AS out_z FROM {STATES} s UNION ALL SELECT user_id, event_type, 90.0, {_txs}, {_INF} FROM {STATES} s WHERE out_z = {_INF} AND value > 90")

_K = "(SELECT o_orderkey AS key, o_custkey AS customer, o_totalprice AS amount, o_orderdate AS d FROM orders)"
_FIRST = f"SELECT key, customer, amount, d AS from_z, {_INF} AS thru_z, d AS in_z, {_INF} AS out_z FROM {_K} k"


def _bt_write(name: str, verb: Callable[[DataFrame, DataFrame, Writer], DataFrame], sql: str) -> None:
    """Verbs on a table with one open rectangle per order, from its date on."""

    def build(s: SparkSession, sf: str) -> DataFrame:
        inf = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
        o = base(s, sf).frame("orders")
        d = F.col("o_orderdate")
        t = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"), d.alias("from_z"), inf.alias("thru_z"), d.alias("in_z"), inf.alias("out_z"))
        return verb(t, o.where(d < F.lit("1995-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("key")), Writer(TIMES, "Contract"))

    _add(name, build, sql)


_V, _U = D(2031, 1, 1), D(2032, 1, 1)
_vs, _us, _old = "TIMESTAMP '2031-01-01'", "TIMESTAMP '2032-01-01'", "d < TIMESTAMP '1995-01-01'"
_CLOSED = f"SELECT key, customer, amount, d AS from_z, {_INF} AS thru_z, d AS in_z, CASE WHEN {_old} THEN {_txs} ELSE {_INF} END AS out_z FROM {_K} k"


def _rect(amount: str, a: str, b: str) -> str:
    return f" UNION ALL SELECT key, customer, {amount}, {a}, {b}, {_txs}, {_INF} FROM {_K} k WHERE {_old}"


_new = lambda k: k.withColumn("amount", F.lit(7.0))
_bt_write("bt_insert", lambda t, k, w: w.bt_insert(t, k.select((F.col("key") + 10000000).alias("key"), F.lit(1).cast("long").alias("customer"), F.lit(5.0).alias("amount")), _TX, _V),
          f"{_FIRST} UNION ALL SELECT key + 10000000, 1, 5.0, {_vs}, {_INF}, {_txs}, {_INF} FROM {_K} k WHERE {_old}")
_bt_write("bt_insert_until", lambda t, k, w: w.bt_insert(t, k.select((F.col("key") + 10000000).alias("key"), F.lit(1).cast("long").alias("customer"), F.lit(5.0).alias("amount")), _TX, _V, _U),
          f"{_FIRST} UNION ALL SELECT key + 10000000, 1, 5.0, {_vs}, {_us}, {_txs}, {_INF} FROM {_K} k WHERE {_old}")
_bt_write("bt_update", lambda t, k, w: w.bt_update(t, _new(k), _TX, _V), _CLOSED + _rect("amount", "d", _vs) + _rect("7.0", _vs, _INF))
_bt_write("bt_update_until", lambda t, k, w: w.bt_update_until(t, _new(k), _TX, _V, _U), _CLOSED + _rect("amount", "d", _vs) + _rect("7.0", _vs, _us) + _rect("amount", _us, _INF))
_bt_write("bt_terminate", lambda t, k, w: w.bt_terminate(t, k, _TX, _V), _CLOSED + _rect("amount", "d", _vs))
_bt_write("bt_terminate_until", lambda t, k, w: w.bt_terminate_until(t, k, _TX, _V, _U), _CLOSED + _rect("amount", "d", _vs) + _rect("amount", _us, _INF))
_bt_write("bt_where", lambda t, k, w: w.bt_where(t, F.col("from_z") < F.lit("1995-01-01").cast("timestamp_ntz"), {"amount": F.lit(7.0)}, _TX, _V, _U), _CLOSED + _rect("amount", "d", _vs) + _rect("7.0", _vs, _us) + _rect("amount", _us, _INF))


def _successive(t: DataFrame, k: DataFrame, w: Writer) -> DataFrame:
    """A second correction inside the middle of the first."""
    once = w.bt_update_until(t, _new(k), _TX, _V, _U)
    return w.bt_update_until(once, k.withColumn("amount", F.lit(8.0)), D(2033, 1, 1), D(2031, 5, 1), D(2031, 7, 1))


_t2, _a2, _b2 = "TIMESTAMP '2033-01-01'", "TIMESTAMP '2031-05-01'", "TIMESTAMP '2031-07-01'"
_bt_write("bt_successive_corrections", _successive, _CLOSED + _rect("amount", "d", _vs) + _rect("amount", _us, _INF)
          + "".join(f" UNION ALL SELECT key, customer, {m}, {a}, {b}, {i}, {o} FROM {_K} k WHERE {_old}" for m, a, b, i, o in (("7.0", _vs, _us, _txs, _t2), ("7.0", _vs, _a2, _t2, _INF), ("8.0", _a2, _b2, _t2, _INF), ("7.0", _b2, _us, _t2, _INF))))

_add("pk_max", lambda s, sf: _pk_max(s, sf),
     "SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS c_custkey, s_suppkey FROM supplier")


def _pk_max(s: SparkSession, sf: str) -> DataFrame:
    c = base(s, sf)
    return allocate_max(c.frame("customer"), c.frame("supplier").select("s_suppkey"), "c_custkey", ["s_suppkey"])


_add("pk_sequence", lambda s, sf: Sequence(50, 2, 100).allocate(base(s, sf).frame("supplier").select("s_suppkey"), "id", ["s_suppkey"]), "SELECT CAST(100 + 2 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS BIGINT) AS id, s_suppkey FROM supplier")


# ---- documents, layouts, generators

LAID = Model(
    Entity("Laid", (_pk("key", "o_orderkey"), A("status", "string"), A("total", "float64"), A("priority", "string", nullable=True)), "laid", document="payload"),
    Entity("Native", (_pk("key", "c_custkey"),), "native", value_objects=(ValueObject("orders", (A("status", "string"), A("total", "float64")), "many"),)),
)
L = LAID.ref


def _laid(s: SparkSession, sf: str) -> Compiler:
    c = base(s, sf)

    def laid() -> DataFrame:
        doc = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"), F.lit("kept").alias("other"))
        return c.frame("orders").select("o_orderkey", F.to_json(doc).alias("payload"))

    def native() -> DataFrame:
        item = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
        per = c.frame("orders").groupBy("o_custkey").agg(F.collect_list(item).alias("orders"))
        customer = c.frame("customer")
        return customer.join(per, customer["c_custkey"] == per["o_custkey"], "left").select("c_custkey", "orders")

    return Compiler(LAID, c.with_table("laid", laid).with_table("native", native))


_add("layout_filter", lambda s, sf: _laid(s, sf).rows(L.Laid.where((L.Laid.total > 300000.0) & (L.Laid.status != "F"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'")
_add("layout_order", lambda s, sf: _laid(s, sf).rows(L.Laid.where(L.Laid.priority.is_not_null()).order_by(L.Laid.total.desc(), L.Laid.key.asc()).limit(30)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
_add("layout_aggregate", lambda s, sf: _laid(s, sf).aggregate(AggregateQuery(L.Laid.where(), (Aggregate("count", "n"), Aggregate("max", "top", "total")), ("status",))), "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
_add("vo_native", lambda s, sf: _laid(s, sf).rows(L.Native.where(L.Native.orders.exists(lambda e: (e.status == "P") & (e.total > 200000.0))), documents=False), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")


def _patched(s: SparkSession, sf: str) -> DataFrame:
    """Documents after some members were assigned; members that no model knows stay."""
    doc = documents.variant(documents.patched(F.col("payload"), {"status": "X", "total": 1.5}))
    rows = _laid(s, sf).catalog.frame("laid")
    return rows.select("o_orderkey", *[documents.leaf(doc, (n,), t).alias(n) for n, t in (("status", "string"), ("total", "float64"), ("priority", "string"), ("other", "string"))])


_add("document_patch", _patched, "SELECT o_orderkey, 'X' AS status, 1.5::DOUBLE AS total, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, 'kept' AS other FROM orders")
_add("document_equality", lambda s, sf: base(s, sf).frame("events").where(documents.same(F.col("props"), F.concat(F.lit('{ "k" : '), (F.col("event_id") % 10).cast("string"), F.lit("}")))).select("event_id"),
     "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = event_id % 10")
_add("vo_leaf_typed", lambda s, sf: base(s, sf).frame("events").select("event_id", documents.leaf(documents.variant(F.col("props")), ("k",), "int64").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_add("generate_accounts", lambda s, sf: generators.accounts(s, 1000).select("id", "owner", F.col("balance").cast("double").alias("balance"), "version"), "SELECT range AS id, 'owner-' || range AS owner, CAST(range * 100 AS DOUBLE) AS balance, CAST(1 AS INTEGER) AS version FROM range(1, 1001)")
_add("generate_milestones", lambda s, sf: generators.milestones(s, 50, 4).select("id", F.col("val").cast("double").alias("val"), "in_z", "out_z"),
     f"SELECT k AS id, CAST(n * 10 AS DOUBLE) AS val, TIMESTAMP '2024-01-01' + n * INTERVAL 1 DAY AS in_z, CASE WHEN n = 3 THEN {_INF} ELSE TIMESTAMP '2024-01-01' + (n + 1) * INTERVAL 1 DAY END AS out_z FROM (SELECT range AS k FROM range(1, 51)), (SELECT range AS n FROM range(4))")


def _refolded(s: SparkSession, sf: str) -> DataFrame:
    """Milestones from two thirds of the events, then the late third folded in."""
    e = base(s, sf).frame("events").select("user_id", "event_type", "value", "ts")
    number = base(s, sf).frame("events").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("t"))
    e = e.join(number, (F.col("user_id") == F.col("u")) & (F.col("ts") == F.col("t"))).drop("u", "t")
    early, late = e.where("event_id % 3 <> 0").drop("event_id"), e.where("event_id % 3 = 0").drop("event_id")
    return refold(chained(early, ["user_id"], "ts"), late, ["user_id"], "ts").select("user_id", "event_type", "value", "in_z", "out_z")


_add("stream_refold", _refolded, _ST)


def queries() -> dict[str, Built]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts as they were known and valid at one instant, by customer."""
    c = _times(spark, sf)
    q = T.Contract.where(T.Contract.amount > 1000.0).as_of("valid", _PAST).as_of("transaction")
    made = (Aggregate("count", "n"), Aggregate("sum", "total", "amount"))
    return c.aggregate(AggregateQuery(q, made, ("customer",), (Having("n", "greaterThanEquals", 1),), (SortKey("total", True), SortKey("customer"))))

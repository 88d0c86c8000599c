import datetime as dt
from decimal import Decimal

import pytest

from tidemark import Attribute as A
from tidemark import Entity, Model, Query, QueryRejected, SortKey
from tidemark import Relationship as R
from tidemark.expr import All, Nothing, from_dict, to_dict
from tidemark.plans.compile import Compiler
from tidemark.sources.catalog import Catalog, from_rows

MODEL = Model(
    Entity("Order", (
        A("id", "int64", primary_key=True), A("name", "string", max_length=255), A("sku", "string", nullable=True), A("qty", "int32"),
        A("price", "decimal(18,2)"), A("active", "boolean"), A("orderedOn", "date"),
    ), "orders", (
        R("items", "OrderItem", ("id", "orderId"), dependent=True, order_by=(SortKey("id", True),)),
        R("notes", "OrderNote", ("id", "orderId"), order_by=(SortKey("resolvedOn", True, True),)),
    )),
    Entity("OrderItem", (A("id", "int64", primary_key=True), A("orderId", "int64"), A("sku", "string"), A("quantity", "int32")), "order_item",
           (R("order", "Order", reverse_of="items"), R("statuses", "OrderStatus", ("id", "itemId")))),
    Entity("OrderStatus", (A("id", "int64", primary_key=True), A("itemId", "int64", nullable=True), A("code", "string")), "order_status"),
    Entity("OrderNote", (A("id", "int64", primary_key=True), A("orderId", "int64"), A("body", "string"), A("resolvedOn", "date", nullable=True)), "order_note"),
)
O, I, S = MODEL.ref.Order, MODEL.ref.OrderItem, MODEL.ref.OrderStatus


def _order(i, name, sku, qty, price, active, day):
    return {"id": i, "name": name, "sku": sku, "qty": qty, "price": Decimal(price), "active": active, "orderedOn": dt.date.fromisoformat(day)}


@pytest.fixture(scope="module")
def compiler(spark):
    orders = [
        _order(1, "Ada", "A-100", 5, "10.50", True, "2024-01-05"), _order(2, "Linus", "B-200", 10, "20.00", True, "2024-02-10"),
        _order(3, "ada", "A-300", 15, "30.25", False, "2024-03-15"), _order(4, "Margaret", None, 20, "40.00", True, "2024-04-20"),
        _order(42, "50% off_x", "A-999", 30, "99.99", True, "2024-06-30"),
    ]
    items = [{"id": n, "orderId": o, "sku": s, "quantity": q} for n, o, s, q in ((10, 1, "A", 2), (11, 1, "B", 9), (12, 2, "A", 1), (13, 42, "C", 5))]
    statuses = [{"id": 1, "itemId": 10, "code": "open"}, {"id": 2, "itemId": 12, "code": "done"}, {"id": 3, "itemId": None, "code": "open"}]
    notes = [{"id": n, "orderId": 1, "body": "n", "resolvedOn": d} for n, d in ((1, None), (2, dt.date(2024, 1, 1)), (3, dt.date(2024, 2, 1)))]
    frames = {"orders": ("Order", orders), "order_item": ("OrderItem", items), "order_status": ("OrderStatus", statuses), "order_note": ("OrderNote", notes)}
    return Compiler(MODEL, Catalog({t: from_rows(spark, MODEL, e, rows) for t, (e, rows) in frames.items()}))


def ids(compiler, predicate):
    return sorted(r.id for r in compiler.rows(O.where(predicate)).collect())


@pytest.mark.parametrize("predicate, want", [
    (All(), [1, 2, 3, 4, 42]), (Nothing(), []), (O.name == "Ada", [1]), (O.sku != "A-100", [2, 3, 42]), (~(O.sku == "A-100"), [2, 3, 42]),
    (O.price > Decimal("30.25"), [4, 42]), (O.price.between(Decimal("20.00"), Decimal("40.00")), [2, 3, 4]), (O.sku.is_null(), [4]), (O.sku.is_not_null(), [1, 2, 3, 42]),
    (O.sku.not_in(["A-100"]), [2, 3, 42]), (O.sku.not_like("A%"), [2]), (O.name.contains("50%"), [42]), (O.name.contains("f_x"), [42]),
    (O.name.like("a__", ignore_case=True), [1, 3]), (O.name.starts_with("AD", ignore_case=True), [1, 3]), (O.active == True, [1, 2, 4, 42]),  # noqa: E712
    (O.orderedOn >= dt.date(2024, 4, 20), [4, 42]), (O.id.in_([2, 3, 99]), [2, 3]), ((O.qty > 5) & ~((O.qty < 20) | (O.name == "Margaret")), [42]),
    (O.items.exists(), [1, 2, 42]), (O.items.not_exists(), [3, 4]), (~O.items.exists(I.quantity > 4), [2, 3, 4]),
    (O.items.statuses.exists(S.code == "open"), [1]), (O.items.statuses.not_exists(S.code == "open"), [2, 3, 4, 42]),
    (O.items.exists(I.quantity > 8) | (O.qty == 20), [1, 4]), (O.items.exists((I.sku == "A") & I.statuses.not_exists(S.code == "open")), [2]),
])
def test_rows(compiler, predicate, want):
    assert ids(compiler, predicate) == want
    assert from_dict(MODEL, to_dict(predicate)) == predicate


def test_order_limit_and_round_trip(compiler):
    q = O.where().order_by(SortKey("sku", True), SortKey("id")).limit(4)
    assert [r.id for r in compiler.rows(q).collect()] == [2, 42, 3, 1]
    assert [r.id for r in compiler.rows(O.where().order_by(SortKey("sku", nulls_first=True)).limit(2)).collect()] == [4, 1]
    assert Query.from_dict(MODEL, q.to_dict()) == q


def test_semi_joins_never_multiply_and_are_joins(compiler):
    df = compiler.rows(O.where(O.items.exists() & O.items.exists(I.quantity > 1)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and df.count() == 2


def test_fetch(compiler):
    got = {r.id: r for r in compiler.fetch(O.where().include(O.items.statuses, O.items, O.notes, O.items.order)).collect()}
    assert [i.id for i in got[1]["items"]] == [11, 10] and got[3]["items"] == []
    assert [s.code for s in got[1]["items"][1].statuses] == ["open"] and got[1]["items"][0].statuses == []
    assert got[1]["items"][0].order.id == 1
    assert [n.id for n in got[1].notes] == [1, 3, 2]


def test_one_join_for_each_hop(compiler):
    q = O.where().include(O.items, O.items.statuses, O.items.order)
    plan = compiler.fetch(q)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def rejected(rule, query, compiler):
    with pytest.raises(QueryRejected) as e:
        compiler.rows(query() if callable(query) else query)
    assert e.value.rule == rule


@pytest.mark.parametrize("rule, query", [
    ("between-bounds-inverted", lambda: O.where(O.qty.between(5, 1))), ("null-check-non-nullable-member", lambda: O.where(O.name.is_null())),
    ("literal-type-mismatch", lambda: O.where(O.qty == "5")), ("literal-type-mismatch", lambda: O.where(O.active == 1)),
    ("string-predicate-non-string-member", lambda: O.where(O.qty.like("5"))), ("membership-list-empty", lambda: O.where(O.qty.in_([]))),
    ("attribute-outside-active-position", lambda: O.where(I.sku == "A")), ("limit-not-positive", lambda: O.where().limit(0)),
    ("limit-given-twice", lambda: O.where().limit(1).limit(2)), ("temporal-dimension-undeclared", lambda: O.where().as_of("transaction")),
    ("sort-key-outside-result-position", lambda: O.where().order_by(SortKey("nope"))), ("narrow-outside-position", lambda: O.where(I.narrowed())),
    ("reference-unknown-entity", lambda: Query("Nope")),
])
def test_rejections(compiler, rule, query):
    rejected(rule, query, compiler)


def test_filters_reach_the_scan(spark, tmp_path, compiler):
    path = f"{tmp_path}/orders"
    compiler.catalog.frame("orders").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    c = Compiler(MODEL, Catalog({"orders": spark.read.parquet(path)}))
    plan = c.rows(O.where((O.qty > 5) & (O.orderedOn >= dt.date(2024, 2, 1))))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(qty,5)" in plan and "GreaterThanOrEqual(ordered_on,2024-02-01)" in plan

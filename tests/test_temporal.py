import datetime as dt
from decimal import Decimal

import pytest

from tidemark import INFINITY, Entity, Model, QueryRejected, StaleWrite, OptimisticConflict, WriteRejected
from tidemark import Attribute as A
from tidemark import Relationship as R
from tidemark.operators.writes import Writer, changed_only
from tidemark.plans.compile import Compiler
from tidemark.sources.catalog import Catalog, from_rows

D = dt.datetime
MODEL = Model(
    Entity("Balance", (A("id", "int64", "bal_id", primary_key=True), A("acctNum", "string"), A("val", "decimal(18,2)")), "balance", temporality="transaction-time"),
    Entity("Position", (A("id", "int64", "pos_id", primary_key=True), A("val", "decimal(18,2)")), "position", temporality="bitemporal"),
    Entity("Policy", (A("id", "int64", primary_key=True), A("name", "string")), "policy", (R("coverages", "Coverage", ("id", "policyId")),), temporality="bitemporal"),
    Entity("Coverage", (A("id", "int64", primary_key=True), A("policyId", "int64"), A("amount", "int32")), "coverage", temporality="bitemporal"),
    Entity("Season", (A("id", "int64", primary_key=True),), "season", temporality="valid-time"),
)
B, P, PO = MODEL.ref.Balance, MODEL.ref.Position, MODEL.ref.Policy


def bal(i, v, a, b):
    return {"id": i, "acctNum": "ABC"[i - 1], "val": Decimal(v), "in_z": a, "out_z": b}


BALANCES = [bal(1, 100, D(2024, 1, 1), D(2024, 6, 1)), bal(1, 150, D(2024, 6, 1), INFINITY), bal(2, 200, D(2024, 2, 1), INFINITY), bal(3, 50, D(2024, 3, 1), D(2024, 8, 1))]


def pos(v, f, t, i, o, key=1):
    return {"id": key, "val": Decimal(v), "from_z": f, "thru_z": t, "in_z": i, "out_z": o}


POSITIONS = [
    pos(90, D(2024, 1, 1), INFINITY, D(2024, 1, 1), D(2024, 4, 1)),
    pos(100, D(2024, 1, 1), D(2024, 6, 1), D(2024, 4, 1), INFINITY),
    pos(200, D(2024, 6, 1), INFINITY, D(2024, 4, 1), INFINITY),
]


@pytest.fixture(scope="module")
def compiler(spark):
    def four(rows):
        return [r | {"from_z": f, "thru_z": t, "in_z": D(2024, 1, 1), "out_z": INFINITY} for r, f, t in rows]

    policies = four([({"id": 1, "name": "old"}, D(2024, 1, 1), D(2024, 6, 1)), ({"id": 1, "name": "new"}, D(2024, 6, 1), INFINITY)])
    coverages = four([({"id": 7, "policyId": 1, "amount": 10}, D(2024, 1, 1), D(2024, 6, 1)), ({"id": 7, "policyId": 1, "amount": 20}, D(2024, 6, 1), INFINITY)])
    frames = {"balance": ("Balance", BALANCES), "position": ("Position", POSITIONS), "policy": ("Policy", policies), "coverage": ("Coverage", coverages)}
    return Compiler(MODEL, Catalog({t: from_rows(spark, MODEL, e, r) for t, (e, r) in frames.items()}))


def values(df):
    return sorted(int(r.val) for r in df.collect())


@pytest.mark.parametrize("at, want", [
    (D(2023, 12, 31), []), (D(2024, 1, 1), [100]), (D(2024, 5, 31, 23, 59, 59, 999999), [50, 100, 200]), (D(2024, 6, 1), [50, 150, 200]), (D(2024, 8, 1), [150, 200]),
])
def test_intervals_are_half_open(compiler, at, want):
    assert values(compiler.rows(B.where().as_of("transaction", at))) == want


def test_selections(compiler):
    assert values(compiler.rows(B.where())) == [150, 200]
    assert values(compiler.rows(B.where().history("transaction"))) == [50, 100, 150, 200]
    assert values(compiler.rows(B.where().as_of_range("transaction", D(2024, 1, 1), D(2024, 2, 1)))) == [100]
    assert values(compiler.rows(B.where().as_of_range("transaction", D(2024, 6, 1), D(2024, 6, 2)))) == [50, 150, 200]


@pytest.mark.parametrize("valid, tx, want", [
    (None, None, [200]), (D(2024, 3, 1), None, [100]), (None, D(2024, 2, 1), [90]), (D(2024, 3, 1), D(2024, 2, 1), [90]), (D(2024, 7, 1), D(2024, 5, 1), [200]),
])
def test_both_axes(compiler, valid, tx, want):
    assert values(compiler.rows(P.where().as_of("valid", valid).as_of("transaction", tx))) == want


def test_omissions_and_rejections(compiler):
    assert values(compiler.rows(P.where().as_of("valid"))) == [200]
    for q, rule in (
        (P.where(), "valid-time-selection-missing"),
        (B.where().as_of("valid"), "temporal-dimension-undeclared"),
        (B.where().as_of_range("transaction", D(2024, 2, 1), D(2024, 2, 1)), "temporal-range-inverted"),
    ):
        with pytest.raises(QueryRejected) as e:
            compiler.rows(q)
        assert e.value.rule == rule
    with pytest.raises(QueryRejected):
        B.where().as_of("transaction").history("transaction")


def test_pins_go_along_and_edges_read_their_own_past(compiler):
    r = compiler.fetch(PO.where().as_of("valid", D(2024, 3, 1)).include(PO.coverages)).first()
    assert r.name == "old" and [c.amount for c in r.coverages] == [10]
    rows = compiler.fetch(PO.where().history("valid").include(PO.coverages)).collect()
    assert sorted((r.name, r.edge.valid, [c.amount for c in r.coverages]) for r in rows) == [("new", D(2024, 6, 1), [20]), ("old", D(2024, 1, 1), [10])]


def golden(df):
    return sorted((int(r.val), r.from_z, r.thru_z, r.in_z, r.out_z) for r in df.collect())


def test_rectangle_split(spark):
    w = Writer(MODEL, "Position")
    empty = from_rows(spark, MODEL, "Position", [])
    new = spark.createDataFrame([(1, Decimal(100))], "pos_id long, val decimal(18,2)")
    t = w.bt_insert(empty, new, D(2024, 1, 1), D(2024, 1, 1))
    change = spark.createDataFrame([(1, Decimal(200))], "pos_id long, val decimal(18,2)")
    got = golden(w.bt_update_until(t, change, D(2024, 2, 15), D(2024, 3, 1), D(2024, 9, 1)))
    tx = D(2024, 2, 15)
    assert got == sorted([
        (100, D(2024, 1, 1), INFINITY, D(2024, 1, 1), tx), (100, D(2024, 1, 1), D(2024, 3, 1), tx, INFINITY),
        (200, D(2024, 3, 1), D(2024, 9, 1), tx, INFINITY), (100, D(2024, 9, 1), INFINITY, tx, INFINITY),
    ])


def test_windows_at_the_edges_leave_no_empty_rectangles(spark):
    w, t = Writer(MODEL, "Position"), from_rows(spark, MODEL, "Position", POSITIONS)
    change = spark.createDataFrame([(1, Decimal(7))], "pos_id long, val decimal(18,2)")
    tx = D(2025, 1, 1)
    got = golden(w.bt_update_until(t, change, tx, D(2024, 1, 1), D(2024, 6, 1)))
    assert (7, D(2024, 1, 1), D(2024, 6, 1), tx, INFINITY) in got and len(got) == 4
    left = golden(w.bt_terminate_until(t, change.select("pos_id"), tx, D(2024, 1, 1), D(2024, 6, 1)))
    assert len(left) == 3 and (100, D(2024, 1, 1), D(2024, 6, 1), D(2024, 4, 1), tx) in left
    # a window over two rectangles is no keyed write
    with pytest.raises(StaleWrite):
        w.require(t, change, D(2024, 5, 1), D(2024, 7, 1))
    with pytest.raises(WriteRejected):
        w.bt_update_until(t, change, tx, D(2024, 5, 1), D(2024, 5, 1))
    # a predicate write is clipped to each
    from pyspark.sql import functions as F

    got = golden(w.bt_where(t, F.lit(True), {"val": F.lit(Decimal(7)).cast("decimal(18,2)")}, tx, D(2024, 5, 1), D(2024, 7, 1)))
    current = [x for x in got if x[4] == INFINITY]
    assert current == sorted([
        (100, D(2024, 1, 1), D(2024, 5, 1), tx, INFINITY), (7, D(2024, 5, 1), D(2024, 6, 1), tx, INFINITY),
        (7, D(2024, 6, 1), D(2024, 7, 1), tx, INFINITY), (200, D(2024, 7, 1), INFINITY, tx, INFINITY),
    ])


def test_current_rectangles_never_overlap_and_the_past_stays(spark):
    import random

    rng = random.Random(1)
    w, t = Writer(MODEL, "Position"), from_rows(spark, MODEL, "Position", [])
    t = w.bt_insert(t, spark.createDataFrame([(k, Decimal(k)) for k in range(4)], "pos_id long, val decimal(18,2)"), D(2024, 1, 1), D(2024, 1, 1))
    for n in range(5):
        closed = {tuple(r) for r in t.collect() if r.out_z < INFINITY}
        a = D(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 40))
        from pyspark.sql import functions as F

        t = w.bt_where(t, F.col("pos_id") <= n, {"val": F.lit(Decimal(n)).cast("decimal(18,2)")}, D(2024, 2, 1) + dt.timedelta(days=n), a, a + dt.timedelta(days=rng.randint(1, 40)))
        t = spark.createDataFrame(t.collect(), t.schema)
        rows = t.collect()
        assert closed <= {tuple(r) for r in rows}
        for k in range(4):
            now = sorted((r.from_z, r.thru_z) for r in rows if r.pos_id == k and r.out_z == INFINITY)
            assert all(x[1] <= y[0] for x, y in zip(now, now[1:], strict=False)) and all(x < y for x, y in now)
            assert now[0][0] == D(2024, 1, 1) and now[-1][1] == INFINITY


def test_chain_gates_and_no_ops(spark):
    w, t = Writer(MODEL, "Balance"), from_rows(spark, MODEL, "Balance", BALANCES)
    change = spark.createDataFrame([(1, Decimal(9))], "bal_id long, val decimal(18,2)")
    rows = golden_b(w.tt_update(t, change, D(2024, 9, 1)))
    assert (1, 9, D(2024, 9, 1), INFINITY) in rows and (1, 150, D(2024, 6, 1), D(2024, 9, 1)) in rows and len(rows) == 5
    assert (2, 200, D(2024, 2, 1), D(2024, 9, 1)) in golden_b(w.tt_terminate(t, spark.createDataFrame([(2,)], "bal_id long"), D(2024, 9, 1)))
    gated = spark.createDataFrame([(1, Decimal(9), D(2024, 5, 5))], "bal_id long, val decimal(18,2), observed_in timestamp_ntz")
    with pytest.raises(OptimisticConflict):
        w.require(t, gated)
    assert golden_b(w.tt_update(t, gated, D(2024, 9, 1))) == golden_b(t)
    with pytest.raises(StaleWrite):
        w.require(t, spark.createDataFrame([(3,)], "bal_id long"))
    current = compiler_rows(t)
    assert changed_only(current, spark.createDataFrame([(1, Decimal(150)), (2, Decimal(1))], "bal_id long, val decimal(18,2)"), ["bal_id"]).count() == 1


def compiler_rows(t):
    return Compiler(MODEL, Catalog({"balance": t})).rows(B.where())


def golden_b(df):
    return sorted((r.bal_id, int(r.val), r.in_z, r.out_z) for r in df.collect())


def test_valid_time_only(spark):
    t = from_rows(spark, MODEL, "Season", [{"id": 1, "from_z": D(2024, 1, 1), "thru_z": INFINITY}])
    c = Compiler(MODEL, Catalog({"season": t}))
    assert c.rows(MODEL.ref.Season.where().as_of("valid", D(2024, 1, 1))).count() == 1
    assert c.rows(MODEL.ref.Season.where().as_of("valid", D(2023, 1, 1))).count() == 0

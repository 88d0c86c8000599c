import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import INFINITY, Database, Entity, Model, OptimisticConflict, StaleWrite, WriteRejected
from tidemark import Aggregate, AggregateQuery, Having, QueryRejected, SortKey
from tidemark import Attribute as A
from tidemark import Relationship as R
from tidemark.operators.keys import Sequence, allocate_max, numbered
from tidemark.operators.writes import chained
from tidemark.plans.unitofwork import DELETE, INSERT, UPDATE, Instruction, batches, coalesced
from tidemark.sources import generators
from tidemark.sources.catalog import from_rows
from tidemark.sources.store import Store, clustered
from tidemark.streaming.fold import fold_into, refold
from tidemark.types import conforms, wire

D = dt.datetime
MODEL = Model(
    Entity("Account", (A("id", "int64", primary_key=True), A("owner", "string"), A("balance", "float64"), A("version", "int32", optimistic_locking=True)), "account",
           (R("entries", "Entry", ("id", "accountId"), dependent=True),)),
    Entity("Entry", (A("id", "int64", primary_key=True), A("accountId", "int64"), A("amount", "float64")), "entry"),
    Entity("Rate", (A("id", "int64", primary_key=True), A("val", "float64")), "rate", temporality="transaction-time"),
    Entity("Cover", (A("id", "int64", primary_key=True), A("val", "float64")), "cover", temporality="bitemporal"),
)
M = MODEL.ref


@pytest.fixture
def db(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    rows = {"Account": [{"id": i, "owner": f"o{i}", "balance": 100.0 * i, "version": 1} for i in range(1, 5)], "Entry": [], "Rate": [], "Cover": []}
    store.commit({MODEL.table(e): from_rows(spark, MODEL, e, r) for e, r in rows.items()})
    clock = iter(D(2024, 1, 1) + dt.timedelta(days=n) for n in range(100))
    return Database(MODEL, store, lambda: next(clock))


def test_transactions(db):
    def work(tx):
        tx.insert("Account", (9,), {"owner": "new", "balance": 1.0})
        tx.update("Account", (1,), {"balance": 5.0}, observed=1)
        tx.delete("Account", (2,))
        # a read sees what was written
        return tx.find(M.Account.where(M.Account.id == 9)).result().owner

    assert db.transact(work) == "new"
    rows = {r.id: r for r in db.find(M.Account.where()).results()}
    assert set(rows) == {1, 3, 4, 9} and rows[1].balance == 5.0 and rows[1].version == 2 and rows[3].version == 1
    with pytest.raises(OptimisticConflict):
        db.transact(lambda tx: (tx.update("Account", (1,), {"balance": 6.0}, observed=1), tx.flush()))
    with pytest.raises(StaleWrite):
        db.transact(lambda tx: (tx.delete("Account", (77,)), tx.flush()))
    assert db.store.head() == 2
    db.transact(lambda tx: tx.update_where("Account", M.Account.balance >= 300.0, {"balance": 0.0}))
    assert sorted(r.balance for r in db.find(M.Account.where()).results()) == [0.0, 0.0, 1.0, 5.0]
    db.transact(lambda tx: tx.delete_where("Account", M.Account.balance == 0.0))
    assert db.aggregate(AggregateQuery(M.Account.where(), (Aggregate("count", "n"),))).result().n == 2
    assert db.store.catalog(1).frame("account").count() == 4


def test_temporal_transactions(db):
    db.transact(lambda tx: (tx.insert("Rate", (1,), {"val": 1.0}), tx.insert("Cover", (1,), {"val": 1.0}, start=D(2024, 1, 1))))
    db.transact(lambda tx: (tx.update("Rate", (1,), {"val": 2.0}), tx.update_until("Cover", (1,), {"val": 2.0}, D(2024, 3, 1), D(2024, 4, 1))))
    db.transact(lambda tx: tx.terminate_where("Rate", M.Rate.val > 1.5))
    db.transact(lambda tx: tx.update_until_where("Cover", M.Cover.val > 0.0, {"val": 9.0}, D(2024, 3, 15), D(2024, 4, 15)))
    assert db.find(M.Rate.where()).results() == []
    history = db.find_history(M.Rate.where().history("transaction")).results()
    assert sorted((r.val, r.in_z, r.out_z) for r in history) == [(1.0, D(2024, 1, 1), D(2024, 1, 2)), (2.0, D(2024, 1, 2), D(2024, 1, 3))]
    at = lambda d: db.find(M.Cover.where().as_of("valid", d)).result().val
    assert [at(D(2024, m, d)) for m, d in ((2, 1), (3, 1), (3, 15), (4, 14), (4, 15))] == [1.0, 2.0, 9.0, 9.0, 1.0]
    assert db.find(M.Cover.where().as_of("valid", D(2024, 3, 1)).as_of("transaction", D(2024, 1, 1))).result().val == 1.0
    with pytest.raises(WriteRejected):
        db.transact(lambda tx: tx.delete("Rate", (1,)))
    with pytest.raises(WriteRejected):
        db.transact(lambda tx: tx.update("Cover", (1,), {"val": 3.0}))


def test_commits_race(spark, db):
    store = db.store
    base = store.head()
    one = store.catalog().frame("account").limit(1)
    store.commit({"account": one}, base)
    with pytest.raises(OptimisticConflict):
        store.commit({"account": one}, base)
    # a lost race runs the work again
    seen = []

    def work(tx):
        if not seen:
            store.commit({"entry": store.catalog().frame("entry")}, store.head())
        seen.append(1)
        tx.update("Account", (one.first().id,), {"owner": "x"})

    db.transact(work)
    assert len(seen) == 2 and db.find(M.Account.where()).result().owner == "x"


def test_results_and_wire(db):
    with pytest.raises(LookupError):
        db.find(M.Account.where(M.Account.id == 99)).result()
    assert db.find(M.Account.where(M.Account.id == 99)).result_or_none() is None
    assert len(list(db.find(M.Account.where()).pages())) == 4
    body = M.Account.where(M.Account.id == 3).to_dict()
    assert db.wire(body).first().json == '{"id":3,"owner":"o3","balance":300.0,"version":1}'


def test_settling():
    i = lambda verb, key, values=(): Instruction(verb, "Account", (key,), tuple(values))
    got = coalesced([i(INSERT, 1, [("a", 1)]), i(UPDATE, 1, [("a", 2), ("b", 3)]), i(INSERT, 2), i(DELETE, 2), i(UPDATE, 3, [("a", 1)]), i(DELETE, 3)])
    assert got == [i(INSERT, 1, [("a", 2), ("b", 3)]), i(DELETE, 3)]
    with pytest.raises(WriteRejected):
        coalesced([i(DELETE, 1), i(UPDATE, 1)])
    order = batches(MODEL, [Instruction(v, e, (k,)) for k, v in enumerate((DELETE, INSERT)) for e in ("Entry", "Account")])
    assert [(v, e) for v, e, _ in order] == [(INSERT, "Account"), (INSERT, "Entry"), (DELETE, "Entry"), (DELETE, "Account")]


def test_keys(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    for order in ("x", "name"):
        got = [(r[order], r.n) for r in numbered(df, [order]).collect()]
        assert [n for _, n in sorted(got)] == list(range(1, 1001))
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    assert sorted((r.name, r.id) for r in allocate_max(spark.range(0), new, "id", ["name"]).collect()) == [("a", 1), ("b", 2)]
    assert sorted((r.name, r.id) for r in allocate_max(spark.range(5, 8), new, "id", ["name"]).collect()) == [("a", 8), ("b", 9)]
    s = Sequence(10, 5)
    assert sorted(r.id for r in s.allocate(new, "id", ["name"]).collect()) == [1, 6] and s.claim(11) == 51 and s.claim(1) == 151


def test_chain_and_refold(spark):
    e = spark.createDataFrame([(1, "a", D(2024, 1, 1)), (1, "b", D(2024, 1, 3)), (2, "c", D(2024, 1, 2))], "k long, s string, ts timestamp_ntz")
    t = chained(e, ["k"], "ts")
    late = spark.createDataFrame([(1, "late", D(2024, 1, 2)), (1, "b2", D(2024, 1, 3))], "k long, s string, ts timestamp_ntz")
    got = sorted((r.k, r.s, r.in_z, r.out_z) for r in refold(t, late, ["k"], "ts").collect())
    assert got == [(1, "a", D(2024, 1, 1), D(2024, 1, 2)), (1, "b2", D(2024, 1, 3), INFINITY), (1, "late", D(2024, 1, 2), D(2024, 1, 3)), (2, "c", D(2024, 1, 2), INFINITY)]


def test_stream_into_a_store(spark, tmp_path):
    schema = "k long, s string, ts timestamp_ntz"
    store = Store(spark, f"file://{tmp_path}/db")
    store.commit({"t": chained(spark.createDataFrame([], schema), ["k"], "ts")})
    spark.createDataFrame([(1, "b", D(2024, 1, 3))], schema).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([(1, "a", D(2024, 1, 1))], schema).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = fold_into(stream, store, "t", ["k"], "ts", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.s, r.out_z) for r in store.catalog().frame("t").collect()) == [("a", D(2024, 1, 3)), ("b", INFINITY)]


def test_generators_and_layout(spark):
    assert generators.accounts(spark, 3).collect()[2].owner == "owner-3"
    o, i, s = generators.orders_tree(spark, 4, 3, 2)
    assert (o.count(), i.count(), s.count()) == (4, 12, 24) and i.groupBy("order_id").count().where("count <> 3").count() == 0
    m = generators.milestones(spark, 3, 4)
    assert m.where(F.col("out_z") == F.lit(INFINITY)).count() == 3
    assert clustered(MODEL, "Rate", m.withColumn("val", F.col("val").cast("double"))).where("is_current").count() == 3


def test_aggregates(db):
    q = lambda *a, **k: db.aggregate(AggregateQuery(M.Account.where(), *a, **k)).results()
    made = (Aggregate("count", "n"), Aggregate("stdDevSample", "d", "balance"), Aggregate("variancePop", "v", "balance"))
    r = q(made)[0]
    assert r.n == 4 and round(r.d, 6) == 129.099445 and round(r.v, 6) == 12500.0
    assert [x.owner for x in q((Aggregate("sum", "s", "balance"),), ("owner",), (Having("s", "greaterThan", 100.0),), (SortKey("s", True),), 2)] == ["o4", "o3"]
    empty = db.aggregate(AggregateQuery(M.Account.where(M.Account.id == 0), made)).result()
    assert empty.n == 0 and empty.d is None
    for bad in (((), ()), ((Aggregate("sum", "n"),), ()), ((Aggregate("count", "n"), Aggregate("count", "n")), ()), ((Aggregate("median", "n", "id"),), ()), ((Aggregate("count", "n"),), ("nope",))):
        with pytest.raises(QueryRejected):
            q(*bad)


def test_value_spaces():
    assert conforms(True, "boolean") and not conforms(1, "boolean") and not conforms(True, "int32")
    assert conforms(2**31 - 1, "int32") and not conforms(2**31, "int32") and not conforms(float("nan"), "float64")
    import decimal

    assert conforms(decimal.Decimal("1.25"), "decimal(3,2)") and not conforms(decimal.Decimal("1.255"), "decimal(5,2)") and not conforms(1.5, "decimal(5,2)")
    assert not conforms(None, "string") and conforms("6f9619ff-8b86-d011-b42d-00cf4fc964ff", "uuid") and not conforms("x", "uuid")


def test_wire_text(spark):
    df = spark.range(1).select(F.lit(bytearray(b"\x0f\xa0")).alias("b"), F.lit(-0.0).alias("f"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz").alias("i"), F.lit("2024-01-02 03:04:05.000006").cast("timestamp_ntz").alias("t"))
    r = df.select(wire(df.b, "bytes"), wire(df.f, "float64"), wire(df.i, "timestamp"), wire(df.t, "timestamp")).first()
    assert tuple(r) == ("0fa0", "0.0", "infinity", "2024-01-02T03:04:05.000006Z")

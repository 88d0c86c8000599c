"""Writes of composites, document members and valid time through the verbs, stores in buckets, graphs."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from tidemark import AggregateQuery, Aggregate, Database, Entity, Include, Model, QueryRejected, SortKey, WriteRejected
from tidemark import Attribute as A
from tidemark import Relationship as R
from tidemark import ValueObject as VO
from tidemark.graph import edge_of, is_view_loaded, pin_of, view
from tidemark.sources.catalog import from_rows
from tidemark.sources.store import Store, StoredSequence

D = dt.datetime
KEY = A("id", "int64", primary_key=True)
MODEL = Model(
    Entity("Site", (KEY, A("name", "string")), "site", (R("parts", "Part", ("id", "siteId")),), value_objects=(
        VO("place", (A("city", "string"), A("since", "date", nullable=True), A("price", "decimal(8,2)", nullable=True),
                     VO("marks", (A("at", "timestamp", nullable=True), A("raw", "bytes", nullable=True)), "many"))),
    )),
    Entity("Part", (KEY, A("siteId", "int64"), A("n", "int32")), "part", (R("site", "Site", reverse_of="parts"),)),
    Entity("Paper", (KEY, A("title", "string"), A("price", "decimal(8,2)", nullable=True)), "paper", document="body",
           value_objects=(VO("author", (A("name", "string"),)),)),
    Entity("Rent", (KEY, A("amount", "float64")), "rent", temporality="valid-time"),
    Entity("Note", (KEY, A("text", "string")), "note", document="body", temporality="transaction-time"),
)
M = MODEL.ref


@pytest.fixture
def db(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    rows = {
        "Site": [{"id": i, "name": f"s{i}", "place": {"city": "Oslo", "price": Decimal("1.50")}} for i in range(1, 9)],
        "Part": [{"id": 10 * i + k, "siteId": i, "n": k} for i in range(1, 4) for k in range(3)],
        "Paper": [{"id": 1, "title": "a", "price": Decimal("2.00"), "author": {"name": "x"}}, {"id": 2, "title": "b"}],
        "Rent": [], "Note": [],
    }
    tables = {MODEL.table(e): from_rows(spark, MODEL, e, r) for e, r in rows.items()}
    store.commit(tables, buckets={"site": (8, ["id"]), "note": (4, ["id"])})
    clock = iter(D(2024, 1, 1) + dt.timedelta(days=n) for n in range(100))
    return Database(MODEL, store, lambda: next(clock))


def ids(db, q):
    return sorted(r.id for r in db.find(q).results())


def test_composites(db):
    place = {"city": "Bergen", "since": dt.date(2020, 2, 3), "price": Decimal("9.90"), "marks": [{"at": D(2021, 1, 2, 3), "raw": b"\x01\xff"}]}
    db.transact(lambda tx: tx.update("Site", (1,), {"place": place}))
    stored = json.loads(db.find(M.Site.where(M.Site.id == 1)).result().place)
    assert stored == {"city": "Bergen", "since": "2020-02-03", "price": "9.90", "marks": [{"at": "2021-01-02T03:00:00.000000Z", "raw": "01ff"}]}
    p = M.Site.place
    for test in (p.city == "Bergen", p.since < dt.date(2021, 1, 1), p.price > Decimal("9.00"), p.marks.at == D(2021, 1, 2, 3), p.marks.raw == b"\x01\xff"):
        assert ids(db, M.Site.where(test)) == [1]
    db.transact(lambda tx: tx.update_where("Site", (p.city == "Oslo") & (M.Site.id > 6), {"place": {"city": "Voss"}}))
    assert ids(db, M.Site.where(p.city == "Voss")) == [7, 8]
    db.transact(lambda tx: (tx.update("Site", (2,), {"place": None}), tx.insert("Site", (20,), {"name": "n", "place": {"city": "Moss"}})))
    assert db.find(M.Site.where(M.Site.id == 2)).result().place is None and ids(db, M.Site.where(p.city == "Moss")) == [20]


def test_document_members(db):
    db.transact(lambda tx: (tx.update("Paper", (1,), {"price": None}), tx.update("Paper", (2,), {"author": {"name": "y"}}), tx.insert("Paper", (3,), {"title": "c", "price": Decimal("5.00")})))
    got = {r.id: json.loads(r.body) for r in db.find(M.Paper.where()).results()}
    assert got == {1: {"title": "a", "price": None, "author": {"name": "x"}}, 2: {"title": "b", "author": {"name": "y"}}, 3: {"title": "c", "price": "5.00"}}
    db.transact(lambda tx: tx.update_where("Paper", M.Paper.author.name == "y", {"title": "new", "price": Decimal("1.25")}))
    assert ids(db, M.Paper.where((M.Paper.title == "new") & (M.Paper.price == Decimal("1.25")) & (M.Paper.author.name == "y"))) == [2]
    db.transact(lambda tx: tx.insert("Note", (1,), {"text": "one"}))
    db.transact(lambda tx: tx.update("Note", (1,), {"text": "two"}))
    rows = db.find_history(M.Note.where().history("transaction")).results()
    assert sorted((json.loads(r.body)["text"], r.in_z.day, r.out_z.year) for r in rows) == [("one", 1, 2024), ("two", 2, 9999)]


@pytest.mark.parametrize("rule, work", [
    ("write-value-type-mismatch", lambda tx: tx.update("Site", (1,), {"place": "text"})), ("write-value-type-mismatch", lambda tx: tx.update("Site", (1,), {"place": {"city": 5}})),
    ("write-required-attribute-missing", lambda tx: tx.update("Site", (1,), {"place": {"price": None}})), ("unknown-member", lambda tx: tx.update("Site", (1,), {"place": {"city": "x", "zip": 1}})),
    ("write-value-type-mismatch", lambda tx: tx.update("Site", (1,), {"place": {"city": "x", "marks": [{"at": "soon"}]}})), ("unknown-member", lambda tx: tx.update_where("Paper", M.Paper.id == 1, {"nope": 1})),
    ("temporal-keyed-write-multi-row", lambda tx: tx.write({"verb": "insert", "entity": "Rent", "validFrom": "2024-01-01", "rows": [{"id": 1, "amount": 1.0}, {"id": 2, "amount": 1.0}]})),
])
def test_what_does_not_fit_is_rejected(db, rule, work):
    with pytest.raises(WriteRejected) as e:
        db.transact(work)
    assert e.value.rule == rule and db.store.head() == 1


def test_valid_time_alone(db):
    db.transact(lambda tx: tx.insert("Rent", (1,), {"amount": 1.0}, start=D(2024, 1, 1)))
    db.transact(lambda tx: tx.update_until("Rent", (1,), {"amount": 2.0}, D(2024, 3, 1), D(2024, 4, 1)))
    db.transact(lambda tx: tx.terminate("Rent", (1,), start=D(2024, 6, 1)))
    rows = db.find_history(M.Rent.where().history("valid")).results()
    assert sorted((r.from_z, r.thru_z, r.amount) for r in rows) == [(D(2024, 1, 1), D(2024, 3, 1), 1.0), (D(2024, 3, 1), D(2024, 4, 1), 2.0), (D(2024, 4, 1), D(2024, 6, 1), 1.0)]
    assert ids(db, M.Rent.where().as_of("valid", D(2024, 7, 1))) == []


def test_buckets_that_nothing_touches_stay(db, spark):
    before = db.store.manifest()["site"]["paths"]
    db.transact(lambda tx: tx.update("Site", (3,), {"name": "x"}))
    after = db.store.manifest()["site"]["paths"]
    assert sum(before[b] != after[b] for b in before) == 1

    def work(tx):
        tx.delete("Site", (3,))
        assert len(tx.find(M.Site.where()).results()) == 7
        tx.insert("Site", (30,), {"name": "y"})
        tx.delete_where("Site", M.Site.id > 29)
        return len(tx.find(M.Site.where()).results())

    assert db.transact(work) == 7 and ids(db, M.Site.where()) == [1, 2, 4, 5, 6, 7, 8]
    db.transact(lambda tx: tx.delete_where("Site", M.Site.id > 0))
    assert ids(db, M.Site.where()) == [] and db.store.catalog(1).frame("site").count() == 8


def test_sequences_outlive_the_process(db, spark):
    one = StoredSequence(db.store, "s", 5, 2, 10)
    assert [one.claim(3), one.claim(6)] == [10, 20]
    assert StoredSequence(Store(spark, db.store.root), "s", 5, 2, 10).claim(1) == 40
    assert one.claim(1) == 50 and ids(db, M.Site.where()) == list(range(1, 9))


def test_graphs(db):
    q = M.Part.where(M.Part.siteId <= 2).include(Include((("site", ()), ("parts", ()))))
    roots = db.find(q).graph()
    assert len(roots) == 6 and len({id(view(p, "site")) for p in roots}) == 2
    for p in roots:
        assert p in view(view(p, "site"), "parts") and is_view_loaded(p, "site") and not is_view_loaded(view(p, "site"), "nope")
        assert edge_of(p) == pin_of(p) == {}
    with pytest.raises(QueryRejected):
        view(db.find(M.Site.where()).graph()[0], "parts")


def test_wire(db):
    q = AggregateQuery(M.Part.where(M.Part.n > 0), (Aggregate("count", "c"),), ("siteId",), (), (SortKey("siteId"),), 2)
    assert AggregateQuery.from_dict(MODEL, q.to_dict()) == q
    assert [json.loads(r.json) for r in db.wire(q.to_dict()).collect()] == [{"siteId": 1, "c": 2}, {"siteId": 2, "c": 2}]
    body = {"verb": "insert", "entity": "Site", "rows": [{"id": 50, "name": "w", "place": {"city": "c", "since": "2020-01-01", "price": "3.25"}}]}
    db.transact(lambda tx: tx.write(body))
    assert ids(db, M.Site.where(M.Site.place.price == Decimal("3.25"))) == [50]
    db.transact(lambda tx: tx.write({"verb": "insert", "entity": "Rent", "validFrom": "2024-01-01T00:00:00Z", "rows": [{"id": 1, "amount": 1.0}]}))
    assert db.find(M.Rent.where().as_of("valid", D(2024, 1, 1))).result().amount == 1.0


def test_results(db):
    q = M.Note.where().as_of("transaction", D(2024, 1, 5))
    assert db.find(q).pin() == {"transaction": D(2024, 1, 5)} and db.find(M.Note.where()).pin() == {"transaction": None}
    assert [len(p) for p in db.find(M.Part.where()).pages(4)] == [4, 4, 1]
    pairs = db.find(M.Site.where(M.Site.id == 2)).related("parts").df.select("parent.name", "child.n").collect()
    assert sorted(map(tuple, pairs)) == [("s2", 0), ("s2", 1), ("s2", 2)]


def test_models_as_yaml():
    yaml = pytest.importorskip("yaml")
    from tidemark.sources import descriptor

    text = yaml.safe_dump(json.loads(descriptor.dump(MODEL)))
    assert descriptor.load(text).entities == MODEL.entities
    with pytest.raises(yaml.YAMLError):
        descriptor.load("{ [")


def test_merge_back_and_purge(db, spark):
    from tidemark.operators.writes import Writer

    table = db.catalog.frame("part")
    changed = spark.createDataFrame([(10, 1, 77), (99, 3, 5)], "id long, site_id long, n int")
    out = {r.id: (r.site_id, r.n) for r in Writer(MODEL, "Part").upsert(table, changed).collect()}
    assert len(out) == 10 and out[10] == (1, 77) and out[99] == (3, 5) and out[11] == (1, 1)
    assert Writer(MODEL, "Part").purge(table, changed).count() == 8

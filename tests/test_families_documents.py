import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import Attribute as A
from tidemark import Entity, Include, Inheritance, Model, ModelRejected, QueryRejected, WriteRejected
from tidemark import Relationship as R
from tidemark import ValueObject as VO
from tidemark.functions import documents as D
from tidemark.model import TPCS, TPH
from tidemark.operators.writes import Writer
from tidemark.plans.compile import Compiler
from tidemark.plans.includes import canonical, hops, tree
from tidemark.sources import descriptor
from tidemark.sources.catalog import Catalog, from_rows

PORT = Model(
    Entity("Quay", (A("id", "int64", primary_key=True), A("label", "string")), "quay",
           (R("crafts", "Craft", ("id", "berth")), R("motors", "Motor", ("id", "berth")), R("charges", "Charge", ("id", "quayId")))),
    Entity("Craft", (A("hull", "int64", primary_key=True), A("label", "string"), A("berth", "int64", nullable=True)), "craft",
           (R("quay", "Quay", reverse_of="crafts"),), inheritance=Inheritance("root", strategy=TPH, tag_column="rig")),
    Entity("Motor", (A("horsepower", "int32", nullable=True),), relationships=(R("place", "Quay", reverse_of="motors"),), inheritance=Inheritance("abstract-subtype", "Craft")),
    Entity("Work", (A("crew", "int32", nullable=True),), inheritance=Inheritance("abstract-subtype", "Motor")),
    Entity("Liner", (A("cabins", "int32", nullable=True),), inheritance=Inheritance("concrete-subtype", "Motor", tag_value="L")),
    Entity("Tug", (A("pull", "decimal(6,1)", nullable=True),), inheritance=Inheritance("concrete-subtype", "Work", tag_value="T")),
    Entity("Dredger", (A("reach", "float64", nullable=True),), inheritance=Inheritance("concrete-subtype", "Work", tag_value="D")),
    Entity("Sloop", (A("sails", "int32", nullable=True),), inheritance=Inheritance("concrete-subtype", "Craft", tag_value="S")),
    Entity("Charge", (A("number", "int64", primary_key=True), A("quayId", "int64"), A("cents", "int64")), inheritance=Inheritance("root", strategy=TPCS)),
    Entity("Levied", (A("law", "string"),), inheritance=Inheritance("abstract-subtype", "Charge")),
    Entity("Toll", (A("hours", "int32"),), "toll", inheritance=Inheritance("concrete-subtype", "Levied")),
    Entity("Penalty", (A("reason", "string"),), "penalty", inheritance=Inheritance("concrete-subtype", "Levied")),
    Entity("Tip", (A("giver", "string"),), "tip", inheritance=Inheritance("concrete-subtype", "Charge")),
)
Q = PORT.ref


@pytest.fixture(scope="module")
def port(spark):
    rows = lambda e, r: from_rows(spark, PORT, e, r)
    craft = "hull long, rig string, label string, berth long, horsepower int, crew int, cabins int, pull decimal(6,1), reach double, sails int"
    crafts = spark.createDataFrame([
        (1, "T", "Atlas", 7, 900, 5, None, Decimal("45.5"), None, None), (2, "L", "Meridian", 7, 4000, None, 300, None, None, None),
        (3, "S", "Petrel", 8, None, None, None, None, None, 2), (4, "D", "Mole", 9, 700, 9, None, None, 30.0, None), (5, "S", "Wren", None, None, None, None, None, None, 1),
    ], craft)
    return Compiler(PORT, Catalog({
        "craft": crafts, "quay": rows("Quay", [{"id": i, "label": n} for i, n in ((7, "North"), (8, "South"), (9, "East"), (10, "West"))]),
        "toll": rows("Toll", [{"number": 1, "quayId": 7, "cents": 100, "law": "A1", "hours": 5}]),
        "penalty": rows("Penalty", [{"number": 1, "quayId": 7, "cents": 900, "law": "B2", "reason": "late"}]),
        "tip": rows("Tip", [{"number": 2, "quayId": 8, "cents": 50, "giver": "x"}]),
    }))


def labels(df):
    return sorted(r.label for r in df.collect())


def test_one_table(port):
    rows = port.rows(Q.Craft.where()).collect()
    assert sorted((r.label, r.familyVariant) for r in rows) == [("Atlas", "Tug"), ("Meridian", "Liner"), ("Mole", "Dredger"), ("Petrel", "Sloop"), ("Wren", "Sloop")]
    assert labels(port.rows(Q.Motor.where(Q.Motor.horsepower >= 900))) == ["Atlas", "Meridian"]
    assert labels(port.rows(Q.Work.where(Q.Work.crew > 1))) == ["Atlas", "Mole"]
    columns = port.rows(Q.Tug.where()).columns
    assert "familyVariant" not in columns and "cabins" not in columns and {"crew", "pull", "horsepower"} <= set(columns)
    assert labels(port.rows(Q.Craft.where(Q.Tug.narrowed(Q.Tug.pull > 50) | Q.Sloop.narrowed()))) == ["Petrel", "Wren"]
    assert labels(port.rows(Q.Craft.where(~Q.Motor.narrowed()))) == ["Petrel", "Wren"]
    assert labels(port.rows(Q.Craft.where().narrow("Sloop", "Work"))) == ["Atlas", "Mole", "Petrel", "Wren"]
    whole = port.rows(Q.Craft.where())._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in whole


def test_tables_per_subtype(port):
    rows = {(r.familyVariant, r.number): r for r in port.rows(Q.Charge.where()).collect()}
    assert set(rows) == {("Toll", 1), ("Penalty", 1), ("Tip", 2)} and rows["Tip", 2].hours is None and rows["Tip", 2].law is None
    assert port.rows(Q.Levied.where(Q.Levied.law == "B2")).first().familyVariant == "Penalty"
    assert "giver" not in port.rows(Q.Levied.where())._jdf.queryExecution().optimizedPlan().toString()
    assert port.rows(Q.Charge.where(Q.Toll.narrowed(Q.Toll.hours > 9) | Q.Tip.narrowed(Q.Tip.giver == "x"))).count() == 1


def test_navigation_to_families(port):
    assert labels(port.rows(Q.Quay.where(Q.Quay.crafts.exists()))) == ["East", "North", "South"]
    assert labels(port.rows(Q.Quay.where(Q.Quay.motors.exists()))) == ["East", "North"]
    assert labels(port.rows(Q.Quay.where(Q.Quay.crafts.narrow("Sloop").exists()))) == ["South"]
    assert labels(port.rows(Q.Quay.where(Q.Quay.crafts.narrow("Work").exists(Q.Work.crew > 5)))) == ["East"]
    assert labels(port.rows(Q.Quay.where(Q.Quay.charges.exists(Q.Tip.narrowed())))) == ["South"]


def test_views(port):
    got = {r.label: r for r in port.fetch(Q.Quay.where().include(Q.Quay.crafts, Q.Quay.crafts.narrow("Liner", "Tug"))).collect()}
    assert [c.label for c in got["South"].crafts] == ["Petrel"] and got["South"]["crafts[Liner,Tug]"] == [] and got["West"].crafts == []
    assert [c.familyVariant for c in got["North"]["crafts[Liner,Tug]"]] == ["Tug", "Liner"]
    rows = {r.label: r for r in port.fetch(Q.Craft.where().include(Include((("quay", ()),), ("Work",)))).collect()}
    assert rows["Mole"].quay.label == "East" and rows["Meridian"].quay is None
    charges = {r.label: sorted(c.familyVariant for c in r.charges) for r in port.fetch(Q.Quay.where().include(Q.Quay.charges)).collect()}
    assert charges == {"North": ["Penalty", "Toll"], "South": ["Tip"], "East": [], "West": []}


def test_the_way_back_lists_all_siblings(port):
    """Back over a to-one hop is the whole list, not the row it came from."""
    rows = port.fetch(Q.Craft.where(Q.Craft.label == "Atlas").include(Include((("quay", ()), ("crafts", ()))))).collect()
    assert [c.label for c in rows[0].quay.crafts] == ["Atlas", "Meridian"]


def test_only_children_of_chosen_roots_are_grouped(port):
    plan = port.fetch(Q.Quay.where(Q.Quay.label == "North").include(Q.Quay.crafts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    every = port.fetch(Q.Quay.where().include(Q.Quay.crafts))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in every


def test_include_canonical():
    a, b = Include((("x", ()),)), Include((("x", ()), ("y", ())))
    assert canonical((b, a, b)) == (b,) and hops(tree((a, b, Include((("x", ("D",)),))))) == 3


@pytest.mark.parametrize("rule, query", [
    ("subtype-attribute-outside-narrow-scope", lambda: Q.Craft.where(Q.Tug.pull > 1)), ("narrow-outside-position", lambda: Q.Motor.where().narrow("Sloop")),
    ("subtype-selection-duplicate-alternative", lambda: Q.Craft.where().narrow("Tug", "Tug")), ("subtype-selection-overlapping-alternatives", lambda: Q.Craft.where().narrow("Motor", "Dredger")),
    ("narrow-outside-relationship-target", lambda: Q.Quay.where(Q.Quay.motors.narrow("Sloop").exists())), ("narrow-empty-effective-set", lambda: Q.Craft.where(Q.Craft.label == "x").narrow("Tug").where(Q.Liner.narrowed())),
])
def test_rejections(port, rule, query):
    with pytest.raises(QueryRejected) as e:
        port.rows(query())
    assert e.value.rule == rule


def family(*subtypes, root=None):
    base = Entity("Root", (A("id", "int64", primary_key=True),), "root", inheritance=root or Inheritance("root", strategy=TPH, tag_column="kind"))
    return lambda: Model(base, *subtypes)


def sub(name="Sub", parent="Root", role="concrete-subtype", tag="s", **kw):
    return Entity(name, kw.pop("attributes", ()), inheritance=Inheritance(role, parent, tag_value=tag, strategy=kw.pop("strategy", None)), **kw)


@pytest.mark.parametrize("rule, build", [
    ("inheritance-missing-concrete-subtype", family()), ("inheritance-unknown-parent", family(sub(parent="Nope"))), ("inheritance-missing-tag-value", family(sub(tag=None))),
    ("inheritance-duplicate-tag-value", family(sub(), sub("Two"))), ("inheritance-strategy-redeclared", family(sub(strategy=TPH))),
    ("inheritance-temporality-not-root-owned", family(sub(temporality="bitemporal"))), ("inheritance-layout-not-root-owned", family(sub(document="d"))),
    ("inheritance-optimistic-locking-not-root-owned", family(sub(attributes=(A("v", "int32", optimistic_locking=True),)))),
    ("inheritance-tph-descendant-table-forbidden", family(sub(table="t"))), ("inheritance-cycle", lambda: Model(sub("A", "B"), sub("B", "A"))),
    ("inheritance-concrete-without-abstract-root", lambda: Model(sub("A", None))), ("inheritance-missing-root", lambda: Model(sub("A", None, role="abstract-subtype"))),
    ("inheritance-tpcs-abstract-table-forbidden", family(sub(tag=None), root=Inheritance("root", strategy=TPCS))),
    ("inheritance-tag-on-concrete-subtype-strategy", lambda: Model(Entity("Root", (A("id", "int64", primary_key=True),), inheritance=Inheritance("root", strategy=TPCS)), sub())),
    ("inheritance-materialization-key-collision", family(sub(attributes=(A("familyVariant", "string"),)))),
    ("storage-layout-column-collision", lambda: Model(Entity("E", (A("id", "int64", primary_key=True), A("a", "string", "x"), A("b", "string", "x")), "e"))),
    ("storage-layout-table-mapping-collision", lambda: Model(*[Entity(n, (A("id", "int64", primary_key=True),), "same") for n in "AB"])),
    ("metamodel-index-identity-duplicate", lambda: Model(Entity("E", (A("id", "int64", primary_key=True),), "e", unique=(("id",), ("id",))))),
    ("storage-layout-document-member-column-override", lambda: Model(Entity("E", (A("id", "int64", primary_key=True), A("a", "string", "other")), "e", document="d"))),
    ("storage-layout-index-over-document-member", lambda: Model(Entity("E", (A("id", "int64", primary_key=True), A("a", "string")), "e", document="d", unique=(("a",),)))),
])
def test_models_that_are_rejected(rule, build):
    with pytest.raises(ModelRejected) as e:
        build()
    assert e.value.rule == rule


def test_ambiguous_names():
    m = Model(Entity("E", (A("id", "int64", primary_key=True),), "a", namespace="x"), Entity("E", (A("id", "int64", primary_key=True),), "b", namespace="y"))
    assert m.entity("x.E").table == "a"
    with pytest.raises(QueryRejected) as e:
        m.entity("E")
    assert e.value.rule == "reference-ambiguous-entity-name"


def test_models_as_documents():
    assert {k: v for k, v in descriptor.load(descriptor.dump(PORT)).entities.items()} == PORT.entities


# ---- value objects

ADDRESS = VO("address", (
    A("street", "string"), A("city", "string", nullable=True),
    VO("geo", (A("country", "string", nullable=True), A("elevation", "float64", nullable=True))),
    VO("phones", (A("type", "string", nullable=True), A("number", "string", nullable=True)), "many"),
))
CRM = Model(Entity("Customer", (A("id", "int64", primary_key=True), A("name", "string")), "customer", value_objects=(ADDRESS,)))
C = CRM.ref.Customer
STATES = {
    1: json.dumps({"street": "s", "city": "Oslo", "zip": 1, "geo": {"country": "NO", "elevation": 10.5}, "phones": [{"type": "home", "number": "555-1234"}, {"type": "work", "number": "555-9999"}]}),
    2: json.dumps({"street": "s", "city": "Oslo", "geo": {"country": "NO", "elevation": 20}, "phones": [{"type": "home", "number": "555-9999"}]}),
    3: None, 4: "null", 5: "{}", 6: '{"phones": []}', 7: '{"phones": {"type": "home"}}', 8: '{"phones": "home", "geo": "x", "city": {"a": 1}}',
    9: '{"phones": [1, {"type": null}, {"number": "1"}, {"type": "home"}], "city": null}', 10: "not json", 11: "[]",
}


@pytest.fixture(scope="module", params=["json", "variant"])
def crm(spark, request):
    df = spark.createDataFrame([(i, f"n{i}", s) for i, s in STATES.items()], "id long, name string, address string")
    if request.param == "variant":
        df = df.withColumn("address", F.try_parse_json("address"))
    return Compiler(CRM, Catalog({"customer": df}))


EVERY = set(STATES)


@pytest.mark.parametrize("predicate, want", [
    (C.address.city == "Oslo", {1, 2}), (C.address.city != "Bergen", {1, 2}), (C.address.city.is_null(), EVERY - {1, 2}), (C.address.city.is_not_null(), {1, 2}),
    (C.address.geo.elevation > 10.5, {2}), (C.address.geo.elevation.between(10.0, 20.0), {1, 2}), (C.address.geo.exists(), {1, 2}), (C.address.geo.not_exists(), EVERY - {1, 2}),
    (C.address.exists(), EVERY - {3, 4, 10, 11}), (C.address.phones.type == "home", {1, 2, 9}), (C.address.phones.type.not_in(["home"]), {1}),
    (C.address.phones.type != "home", {1}), (C.address.phones.type.is_null(), {9}), (C.address.phones.exists(), {1, 2, 9}), (C.address.phones.not_exists(), EVERY - {1, 2, 9}),
    ((C.address.phones.type == "home") & (C.address.phones.number == "555-9999"), {1, 2}),
    (C.address.phones.exists(lambda e: (e.type == "home") & (e.number == "555-9999")), {2}),
    (C.address.phones.not_exists(lambda e: (e.type == "home") & (e.number == "555-9999")), EVERY - {2}),
    (~(C.address.phones.type == "home"), EVERY - {1, 2, 9}), (C.address.phones.number.ends_with("9999"), {1, 2}), (C.address.geo.exists(lambda e: e.elevation > 15.0), {2}),
    (C.address.city.like("os%", ignore_case=True), {1, 2}), (C.address.geo.country.in_(["NO"]), {1, 2}),
])
def test_stored_states(crm, predicate, want):
    assert {r.id for r in crm.rows(C.where(predicate)).collect()} == want


def test_native_documents(spark):
    schema = "id long, name string, address struct<street string, city string, geo struct<country string, elevation double>, phones array<struct<type string, number string>>>"
    df = spark.createDataFrame([(1, "a", ("s", "Oslo", ("NO", 1.0), [("home", "1"), (None, "2")])), (2, "b", None), (3, "c", ("s", None, None, None))], schema)
    c = Compiler(CRM, Catalog({"customer": df}))
    ids = lambda p: sorted(r.id for r in c.rows(C.where(p)).collect())
    assert ids(C.address.city == "Oslo") == [1] and ids(C.address.phones.type != "work") == [1]
    assert ids(C.address.phones.not_exists()) == [2, 3] and ids(C.address.exists()) == [1, 3]
    assert ids(C.address.phones.exists(lambda e: (e.type == "home") & (e.number == "2"))) == []


@pytest.mark.parametrize("rule, predicate", [
    ("nested-literal-type-mismatch", lambda: C.address.geo.elevation == "high"), ("nested-string-predicate-non-string-member", lambda: C.address.geo.elevation.like("1%")),
    ("nested-path-first-segment-not-value-object", lambda: from_path("name", "city")), ("navigate-value-object-target", lambda: related("address")),
])
def test_document_rejections(crm, rule, predicate):
    with pytest.raises(QueryRejected) as e:
        crm.rows(C.where(predicate()))
    assert e.value.rule == rule


def from_path(*path):
    from tidemark.expr import Compare, Ref

    return Compare("eq", Ref("Customer", path), "x")


def related(name):
    from tidemark.expr import Related

    return Related("Customer", name)


def test_document_functions(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"x": [1, "q"]}, "zip": "é"}',), (None,), ("[1]",)], "j string")
    got = [json.loads(r[0]) for r in df.select(D.patched(F.col("j"), {"b": [2], "n": None})).collect()]
    assert got[0] == {"a": {"x": [1, "q"]}, "zip": "é", "b": [2], "n": None} and got[1] == got[2] == {"b": [2], "n": None}
    same = spark.createDataFrame([('{"a":1,"b":2}', '{ "b":2, "a":1 }', True), ("[1,2]", "[2,1]", False), (None, None, True)], "x string, y string, w boolean")
    assert all(r[0] == r[1] for r in same.select(D.same(F.col("x"), F.col("y")), "w").collect())


def test_document_layout(spark):
    m = Model(Entity("Doc", (A("id", "int64", primary_key=True), A("name", "string"), A("price", "decimal(10,2)")), "doc", document="payload"))
    assert [c for c, _, _ in m.layout("Doc")] == ["id", "payload"]
    df = spark.createDataFrame([(1, '{"name": "a", "price": "1.50"}'), (2, '{"name": "b", "price": 7}'), (3, "{}")], "id long, payload string")
    c = Compiler(m, Catalog({"doc": df}))
    assert [r.id for r in c.rows(m.ref.Doc.where(m.ref.Doc.price > Decimal("1.00")).order_by(m.ref.Doc.price.desc())).collect()] == [2, 1]
    assert c.rows(m.ref.Doc.where(m.ref.Doc.name == "a")).first().id == 1


# ---- write validation

@pytest.mark.parametrize("rule, run", [
    ("abstract-write-target", lambda: Writer(PORT, "Work")), ("subtype-write-sibling-attribute", lambda: Writer(PORT, "Tug").validate({"sails": 1})),
    ("subtype-write-metadata-field", lambda: Writer(PORT, "Tug").validate({"rig": "S"})), ("write-value-type-mismatch", lambda: Writer(PORT, "Tug").validate({"label": 5})),
    ("write-required-attribute-missing", lambda: Writer(PORT, "Tug").validate({"hull": 1}, insert=True)),
    ("write-required-value-object-missing", lambda: Writer(Model(Entity("E", (A("id", "int64", primary_key=True),), "e", value_objects=(VO("v", (), nullable=False),))), "E").validate({"id": 1}, insert=True)),
    ("subtype-write-set-based-unsupported", lambda: Writer(PORT, "Tug").delete_where(None, None)),
])
def test_writes_that_are_rejected(rule, run):
    with pytest.raises(WriteRejected) as e:
        run()
    assert e.value.rule == rule


def test_family_writes(spark, port):
    table = port.catalog.frame("craft")
    w = Writer(PORT, "Sloop")
    more = w.insert(table, spark.createDataFrame([(9, "Gull")], "hull long, label string"))
    assert more.where("hull = 9").first().rig == "S"
    changed = w.update(more, spark.createDataFrame([(9, "Tern"), (1, "no sloop")], "hull long, label string"))
    assert {r.hull: r.label for r in changed.collect()}[1] == "Atlas" and changed.where("hull = 9").first().label == "Tern"

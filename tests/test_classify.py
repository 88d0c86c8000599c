import pytest

from tidemark import Attribute as A
from tidemark import Entity, Inheritance, Model
from tidemark import ValueObject as VO
from tidemark.model import TPH
from tidemark.operators import classify as K
from tidemark.plans.compile import Compiler
from tidemark.sources.catalog import Catalog

MODEL = Model(
    Entity("Customer", (A("id", "int64", primary_key=True), A("name", "string")), "customer", value_objects=(
        VO("address", (
            A("street", "string"), A("height", "float64", nullable=True),
            VO("geo", (A("country", "string", nullable=True),), nullable=True),
            VO("phones", (A("type", "string"),), "many"),
        ), nullable=False),
    )),
    Entity("Beast", (A("id", "int64", primary_key=True),), "beast", inheritance=Inheritance("root", strategy=TPH, tag_column="kind")),
    Entity("Dog", inheritance=Inheritance("concrete-subtype", "Beast", tag_value="dog")),
    Entity("Doc", (A("id", "int64", primary_key=True), A("price", "decimal(5,2)"), A("note", "string", nullable=True)), "doc", document="payload"),
)

CASES = [
    ('{"street": "s", "phones": [{"type": "a"}], "more": 1}', []), ('{"street": "s"}', []), (None, [(K.ABSENT, "address")]), ("null", [(K.NULL, "address")]),
    ("[]", [(K.ONE_KIND, "address")]), ("no json", [(K.ONE_KIND, "address")]), ("{}", [(K.ABSENT, "address.street")]), ('{"street": null}', [(K.NULL, "address.street")]),
    ('{"street": {"x": 1}}', [(K.LEAF, "address.street")]), ('{"street": "s", "height": "tall"}', [(K.LEAF, "address.height")]), ('{"street": "s", "geo": 5}', [(K.ONE_KIND, "address.geo")]),
    ('{"street": "s", "phones": {}}', [(K.MANY_KIND, "address.phones")]), ('{"street": "s", "phones": [1, {"type": "a"}]}', [(K.MANY_KIND, "address.phones")]),
    ('{"street": "s", "phones": [{"type": "a"}, {}]}', [(K.ABSENT, "address.phones[1].type")]), ('{"street": "s", "phones": null, "geo": null}', []),
]


def issues(df):
    return {r.id: (sorted((i.code, i.path) for i in r.issues), r.available) for r in df.collect()}


def test_documents(spark):
    df = spark.createDataFrame([(i, "n", s) for i, (s, _) in enumerate(CASES)], "id long, name string, address string")
    got = issues(Compiler(MODEL, Catalog({"customer": df})).classified(MODEL.ref.Customer.where()))
    for i, (text, want) in enumerate(CASES):
        assert got[i] == (sorted(want), all(c not in K.UNAVAILABLE for c, _ in want)), text


def test_columns_tags_and_layouts(spark):
    c = Compiler(MODEL, Catalog({
        "customer": spark.createDataFrame([(None, None, '{"street": "s"}')], "id long, name string, address string"),
        "beast": spark.createDataFrame([(1, "dog"), (2, "cat"), (3, None)], "id long, kind string"),
        "doc": spark.createDataFrame([(1, '{"price": 1.5}'), (2, "{}"), (3, '{"price": null}'), (4, '{"price": "x", "note": 1}'), (5, "[]")], "id long, payload string"),
    }))
    assert issues(c.classified(MODEL.ref.Customer.where())) == {None: ([(K.ATTRIBUTE, "name"), (K.KEY_NULL, "id")], False)}
    assert issues(c.classified(MODEL.ref.Beast.where())) == {1: ([], True), 2: ([(K.TAG, "kind")], False), 3: ([(K.TAG, "kind")], False)}
    got = issues(c.classified(MODEL.ref.Doc.where()))
    assert got[1] == ([], True) and got[4] == ([(K.LEAF, "price")], False)
    assert all(got[i] == ([(K.ATTRIBUTE, "price")], False) for i in (2, 3, 5))


def test_other_sources(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "c_custkey long, c_name string").write.json(f"{tmp_path}/x")
    spark.range(3).createOrReplaceTempView("three")
    assert Catalog.read(spark, {"t": ("json", {"path": f"{tmp_path}/x"})}).frame("t").count() == 1
    c = Catalog.tables(spark, {"t": "three"})
    assert c.frame("t").count() == 3
    with pytest.raises(TypeError):
        Catalog({"customer": spark.range(1)}).check(MODEL, "Customer")

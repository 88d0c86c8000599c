"""Stored data that does not conform to the model, as a column of issues beside each row.

Reading never repairs data: a row is available if every value that was asked for
follows from a rule of absence, and otherwise it is not, whatever else is right.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..model import TPH, Attribute, ValueObject
from ..query import Query

if TYPE_CHECKING:
    from ..plans.compile import Compiler

#: The closed set of issue codes.
ABSENT = "stored-data-required-member-absent"
NULL = "stored-data-required-member-null"
ONE_KIND = "stored-data-one-wrong-kind"
MANY_KIND = "stored-data-many-wrong-kind"
LEAF = "stored-data-leaf-undecodable"
ATTRIBUTE = "stored-data-attribute-null"
TAG = "stored-data-family-tag-unknown"
KEY_NULL = "stored-data-primary-key-null"
KEY_BAD = "stored-data-primary-key-undecodable"
#: Issues that leave a row without usable data.
UNAVAILABLE = (LEAF, ATTRIBUTE, TAG, KEY_NULL, KEY_BAD)

_TYPE = "array<struct<code:string,path:string>>"


def _none() -> Column:
    return F.array().cast(_TYPE)


def _issue(code: str, path: Column, when: Column) -> Column:
    made = F.array(F.struct(F.lit(code).alias("code"), path.alias("path")))
    return F.when(F.coalesce(when, F.lit(False)), made).otherwise(_none())


def _kind(v: Column, prefix: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(prefix), F.lit(False))


def _member(m: Attribute | ValueObject, doc: Column, path: Column) -> Column:
    """Issues of a member of an object."""
    at = F.try_variant_get(doc, D.json_path((m.name,)), "variant")
    where = F.concat(path, F.lit(f".{m.name}"))
    return value(m, at, where)


def value(m: Attribute | ValueObject, at: Column, path: Column) -> Column:
    """Issues of a stored value: null is an absent one, a variant null a JSON null."""
    absent, void = at.isNull(), _kind(at, "VOID")
    many = isinstance(m, ValueObject) and m.many
    out = [] if m.nullable or many else [_issue(ABSENT, path, absent), _issue(NULL, path, void)]
    there = ~absent & ~void
    if isinstance(m, Attribute):
        scalar = F.try_variant_get(at, "$", "variant")
        bad = D.leaf(scalar, (), m.type).isNull()
        return F.concat(*out, _issue(LEAF, path, there & bad))
    if not many:
        inner = F.concat(_none(), *[_member(x, at, path) for x in m.members])
        return F.concat(*out, _issue(ONE_KIND, path, there & ~_kind(at, "OBJECT")), F.when(_kind(at, "OBJECT"), inner).otherwise(_none()))
    items = F.try_variant_get(at, "$", "array<variant>")
    odd = items.isNull() | F.exists(F.coalesce(items, F.array().cast("array<variant>")), lambda e: ~_kind(e, "OBJECT"))

    def one(e: Column, i: Column) -> Column:
        place = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.concat(_none(), *[_member(x, e, place) for x in m.members])

    inner = F.flatten(F.transform(items, one))
    return F.concat(*out, _issue(MANY_KIND, path, there & odd), F.when(there & ~odd, inner).otherwise(_none()))


def classified(compiler: Compiler, q: Query) -> DataFrame:
    """Rows with ``issues`` (code and path of each) and ``available``."""
    m, at = compiler.model, compiler.roots(q)
    root, parts = m.root(q.target), [_none()]
    names = {x.name: x for c in sorted(at.active) for x in (*m.attributes(c), *m.value_objects(c))}
    everywhere = {n for n in names if all(m.attribute(c, n) or m.value_object(c, n) for c in at.active)}
    for n in sorted(everywhere):
        x, path = names[n], F.lit(n)
        if isinstance(x, ValueObject):
            if root.document:
                stored = F.try_variant_get(D.variant(at.col(root.document)), D.json_path((n,)), "variant")
            else:
                text = at.col(x.column)
                # text that is no JSON is of no kind that could be read
                stored = D.variant(text)
                parts.append(_issue(MANY_KIND if x.many else ONE_KIND, path, text.isNotNull() & stored.isNull()))
                stored = F.when(text.isNull() | stored.isNotNull(), stored)
                parts.append(F.when(text.isNull() | stored.isNotNull(), value(x, stored, path)).otherwise(_none()))
                continue
            parts.append(value(x, stored, path))
        elif root.document and x.column not in at.types:
            stored = F.try_variant_get(D.variant(at.col(root.document)), D.json_path((n,)), "variant")
            gone = stored.isNull() | _kind(stored, "VOID")
            if not x.nullable:
                parts.append(_issue(ATTRIBUTE, path, gone))
            parts.append(_issue(LEAF, path, ~gone & at.attribute(x).isNull()))
        elif x.primary_key:
            parts.append(_issue(KEY_NULL, path, at.attribute(x).isNull()))
        elif not x.nullable:
            parts.append(_issue(ATTRIBUTE, path, at.attribute(x).isNull()))
    if m.strategy(q.target) == TPH:
        tags = [e.inheritance.tag_value for e in m.concretes(root.qualified)]
        tag = at.col(root.inheritance.tag_column)
        parts.append(_issue(TAG, F.lit(root.inheritance.tag_column), tag.isNull() | ~tag.isin(*tags)))
    issues = reduce(F.concat, parts)
    rows = at.df.select(*[at.col(c).alias(c) for c in compiler.columns(at)], issues.alias("issues"))
    return rows.withColumn("available", ~F.exists("issues", lambda i: i["code"].isin(*UNAVAILABLE)))

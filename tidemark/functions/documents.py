"""JSON documents: typed leaves, list guards, presence, patches, equality.

Leaves are read with ``try_`` functions: what is absent, null, of another kind
or not JSON at all is simply not present, and no bad document fails a query.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import spark_type

#: Types whose leaves are compared by value; the others are compared as text.
_TYPED = ("int32", "int64", "float32", "float64", "boolean")


def variant(text: Column) -> Column:
    return F.try_parse_json(text)


def json_path(names: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def leaf(doc: Column, names: tuple[str, ...], type_: str) -> Column:
    """A typed leaf of a variant, null where it is not present or not of its type."""
    if type_ in _TYPED or type_.startswith("decimal"):
        return F.try_variant_get(doc, json_path(names), spark_type(type_).simpleString())
    text = F.try_variant_get(doc, json_path(names), "string")
    # an object or a list is not a scalar
    whole = F.try_variant_get(doc, json_path(names), "variant")
    scalar = ~F.schema_of_variant(whole).rlike("^(OBJECT|ARRAY)")
    text = F.when(scalar, text)
    if type_ in ("string", "uuid"):
        return F.lower(text) if type_ == "uuid" else text
    if type_ == "bytes":
        return F.when(text.rlike("^([0-9a-f]{2})*$"), F.unhex(text))
    cast = {"timestamp": "timestamp_ntz", "time": "time(6)"}.get(type_, type_)
    return text.try_cast(cast)


def elements(doc: Column, names: tuple[str, ...]) -> Column:
    """The list at a path as array of variants; what is no list has no elements."""
    return F.coalesce(F.try_variant_get(doc, json_path(names), "array<variant>"), F.array().cast("array<variant>"))


def is_object(doc: Column, names: tuple[str, ...]) -> Column:
    at = F.try_variant_get(doc, json_path(names), "variant") if names else doc
    return F.coalesce(F.schema_of_variant(at).startswith("OBJECT"), F.lit(False))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and without white space, for structural equality; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def same(a: Column, b: Column) -> Column:
    return canonical(a).eqNullSafe(canonical(b))


def read_pair(col: Column) -> tuple[Column, Column]:
    """(present, document): tells an absent document from a JSON null."""
    return col.isNotNull(), col


def merged(text: Column, patch: Column) -> Column:
    """The object with the top-level members of another set, and all others kept, unknown ones too.

    What is no object counts as an empty one.
    """
    none = F.create_map().cast("map<string,variant>")
    members = lambda t: F.coalesce(F.try_variant_get(F.try_parse_json(t), "$", "map<string,variant>"), none)
    new = members(patch)
    return F.to_json(F.map_concat(F.map_filter(members(text), lambda k, _: ~F.map_contains_key(new, k)), new))


def patched(text: Column, assigned: dict[str, Any]) -> Column:
    """``merged`` with members of given values."""
    return merged(text, F.lit(json.dumps(assigned)))

"""One accessor for value objects, stored as JSON text or as native structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import documents as D


class JsonDoc:
    """A position in a JSON document."""

    def __init__(self, doc: Column, names: tuple[str, ...] = ()) -> None:
        self.doc, self.names = doc, names

    def at(self, name: str) -> JsonDoc:
        return JsonDoc(self.doc, (*self.names, name))

    def leaf(self, type_: str) -> Column:
        return D.leaf(self.doc, self.names, type_)

    def is_object(self) -> Column:
        return D.is_object(self.doc, self.names)

    def count(self) -> Column:
        return F.size(D.elements(self.doc, self.names))

    def any(self, test: Callable[[JsonDoc], Column]) -> Column:
        found = F.exists(D.elements(self.doc, self.names), lambda e: F.coalesce(test(JsonDoc(e)), F.lit(False)))
        return F.coalesce(found, F.lit(False))


class NativeDoc:
    """A position in a struct column or an array of structs: the fast path for clean data."""

    def __init__(self, col: Column) -> None:
        self.col = col

    def at(self, name: str) -> NativeDoc:
        return NativeDoc(self.col.getField(name))

    def leaf(self, type_: str) -> Column:
        return self.col

    def is_object(self) -> Column:
        return self.col.isNotNull()

    def count(self) -> Column:
        return F.coalesce(F.size(self.col), F.lit(0))

    def any(self, test: Callable[[NativeDoc], Column]) -> Column:
        found = F.exists(self.col, lambda e: F.coalesce(test(NativeDoc(e)), F.lit(False)))
        return F.coalesce(found, F.lit(False))

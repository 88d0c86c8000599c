"""Tables by name: where a model's entities find their rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import Model
from ..types import document_value


class Catalog:
    """Lazy DataFrames for table names; nothing is read until a query runs."""

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], buckets: Mapping[str, Any] | None = None) -> None:
        self._tables = dict(tables)
        #: tables that a store keeps in buckets and that nothing replaced
        self.buckets = dict(buckets or {})

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        return Catalog({n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    @staticmethod
    def read(spark: SparkSession, sources: Mapping[str, tuple[str, Mapping[str, str]]]) -> Catalog:
        """Tables of any Spark source: name to (format, options), e.g. jdbc with url and dbtable."""
        return Catalog({n: (lambda f=f, o=o: spark.read.format(f).options(**o).load()) for n, (f, o) in sources.items()})

    @staticmethod
    def tables(spark: SparkSession, names: Mapping[str, str]) -> Catalog:
        """Tables of the session's own catalog: name here to name there."""
        return Catalog({n: (lambda t=t: spark.table(t)) for n, t in names.items()})

    def frame(self, table: str) -> DataFrame:
        made = self._tables[table]
        if not isinstance(made, DataFrame):
            made = self._tables[table] = made()
        return made

    def with_table(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Catalog:
        return Catalog({**self._tables, name: df}, self.buckets)

    def check(self, model: Model, name: str) -> None:
        """Assert that a table has the columns and types that its entity declares; value objects may be native."""
        have = {f.name: f.dataType for f in self.frame(model.table(name)).schema}
        documents = {v.column for v in model.value_objects(name)}
        for column, kind, _ in model.layout(name):
            got = have.get(column)
            native = column in documents and isinstance(got, (T.StructType, T.ArrayType, T.VariantType))
            if got is None or (got != kind and not native):
                raise TypeError(f"{name}.{column}: declared {kind.simpleString()}, table has {got}")


def stored(model: Model, name: str, row: dict[str, Any]) -> dict[str, Any]:
    """A row keyed by member or column name as values by column: composites as JSON, members of a document in it.

    A document or composite that is text already is taken as its JSON.
    """
    by_name = {a.name: a.column for a in model.attributes(name)} | {v.name: v.column for v in model.value_objects(name)}
    composites = {v.name: v for v in model.value_objects(name)}
    resident, document = model.resident(name), {}
    out: dict[str, Any] = {}
    for k, v in row.items():
        made = composites[k].encoded(v) if k in composites and not isinstance(v, str) else v
        if k in resident:
            document[k] = made if k in composites else document_value(v, resident[k].type)
        elif k in composites and not isinstance(v, str) and v is not None:
            out[by_name[k]] = json.dumps(made)
        else:
            out[by_name.get(k, k)] = v
    if document:
        out[model.root(name).document] = json.dumps(document)
    return out


def from_rows(spark: SparkSession, model: Model, name: str, rows: list[dict]) -> DataFrame:
    """Rows keyed by attribute or column name, as the entity's table."""
    schema = model.schema(name)
    keyed = [stored(model, name, r) for r in rows]
    unknown = {k for r in keyed for k in r} - set(schema.names)
    if unknown:
        raise KeyError(f"{name} has no column {sorted(unknown)}")
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in keyed], loose)

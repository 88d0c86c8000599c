"""Deletion of rows with all that depend on them, dependents first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import ModelRejected
from ..model import Model
from ..sources.catalog import Catalog


def cascade_delete(model: Model, catalog: Catalog, name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Table name to its rows that are left; ``keys`` has the key columns of the rows to delete.

    Only relationships that own their target are followed. A table that is
    reached over several paths loses what any of them reaches.
    """
    out: dict[str, DataFrame] = {}
    pending = [(name, keys, ())]
    while pending:
        entity, gone, path = pending.pop()
        if entity in path:
            raise ModelRejected("dependent-cycle", " > ".join((*path, entity)))
        table = model.table(entity)
        rows = out.get(table)
        rows = catalog.frame(table) if rows is None else rows
        key = gone.columns
        doomed = catalog.frame(table).join(gone, key, "left_semi")
        out[table] = rows.join(gone, key, "left_anti")
        for r in model.relationships(entity):
            if r.dependent and r.reverse_of is None:
                own, other = model.attribute(entity, r.join[0]), model.attribute(r.target, r.join[1])
                below = doomed.select(doomed[own.column].alias(other.column)).distinct()
                pending.append((r.target, below, (*path, entity)))
    return out

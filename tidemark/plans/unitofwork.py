"""A unit of work: instructions are buffered, settled, ordered and applied as whole-table transforms."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import WriteRejected
from ..model import Model
from ..operators.writes import Writer
from ..sources.catalog import Catalog, from_rows, stored

INSERT, UPDATE, DELETE = "insert", "update", "delete"


@dataclass(frozen=True)
class Instruction:
    """A keyed write: verb, entity, key and assigned values; a valid window on bitemporal entities."""

    verb: str
    entity: str
    key: tuple[Any, ...]
    values: tuple[tuple[str, Any], ...] = ()
    window: tuple[dt.datetime | None, dt.datetime | None] = (None, None)
    observed: Any = None


def coalesced(instructions: list[Instruction]) -> list[Instruction]:
    """What is left of a transaction's instructions for each row.

    An insert takes up later updates; an insert that is deleted again is
    nothing; of several updates the last value of each member counts; a delete
    takes the place of updates before it. Windows are settled one by one.
    """
    out: list[Instruction] = []
    at: dict[tuple[str, tuple[Any, ...]], int] = {}
    gone: set[int] = set()
    for i in instructions:
        k = (i.entity, i.key)
        n = at.get(k)
        if n is None or i.window != (None, None) or out[n].window != (None, None):
            at[k] = len(out)
            out.append(i)
            continue
        old = out[n]
        if i.verb == UPDATE and old.verb in (INSERT, UPDATE):
            out[n] = replace(old, values=tuple((dict(old.values) | dict(i.values)).items()))
        elif i.verb == DELETE and old.verb == INSERT:
            gone.add(n)
            del at[k]
        elif i.verb == DELETE and old.verb == UPDATE:
            out[n] = replace(i, observed=old.observed if i.observed is None else i.observed)
        elif i.verb == INSERT and old.verb == DELETE:
            at[k] = len(out)
            out.append(i)
        else:
            raise WriteRejected("write-after-delete" if old.verb == DELETE else "duplicate-insert", f"{i.entity} {i.key}")
    return [x for n, x in enumerate(out) if n not in gone]


def depth(model: Model, name: str) -> int:
    """How many owners stand above an entity: parents are written first and deleted last."""
    seen: set[str] = set()

    def walk(entity: str) -> int:
        if entity in seen:
            return 0
        seen.add(entity)
        above = [
            e.qualified
            for e in model
            for r in e.relationships
            if r.reverse_of is None and model.entity(r.target).qualified == entity and e.qualified != entity
        ]
        return max((1 + walk(a) for a in above), default=0)

    return walk(model.entity(name).qualified)


def batches(model: Model, instructions: list[Instruction]) -> list[tuple[str, str, list[Instruction]]]:
    """(verb, entity, instructions) in the order inserts from the top, updates, deletes from the bottom.

    Instructions of one batch have the same window and members, and each key once.
    """
    grouped: dict[tuple, list[Instruction]] = defaultdict(list)
    turn: dict[tuple, int] = defaultdict(int)
    for i in instructions:
        key = (i.entity, i.key)
        # repeated windows on one key are generations, applied one after the other
        n = turn[key]
        turn[key] += 1
        d = depth(model, i.entity)
        order = {INSERT: (0, d), UPDATE: (1, d), DELETE: (2, -d)}[i.verb]
        members = tuple(sorted(m for m, _ in i.values))
        grouped[(n, order, i.verb, i.entity, i.window != (None, None) and i.window or (), members, i.observed is not None)].append(i)
    ordered = sorted(grouped.items(), key=lambda x: (x[0][0], x[0][1], x[0][3], str(x[0][4]), x[0][5]))
    return [(k[2], k[3], v) for k, v in ordered]


class UnitOfWork:
    """Collects instructions and applies them all, or none, with one transaction instant."""

    def __init__(self, spark: SparkSession, model: Model, catalog: Catalog) -> None:
        self.spark, self.model, self.catalog = spark, model, catalog
        self.buffer: list[Instruction] = []

    def add(self, verb: str, entity: str, key: tuple[Any, ...], values: dict[str, Any] | None = None, start=None, until=None, observed=None) -> None:
        name = self.model.entity(entity).qualified
        writer = Writer(self.model, name)
        pk = [a.name for a in self.model.primary_key(name)]
        if verb == INSERT:
            writer.validate(dict(zip(pk, key, strict=True)) | (values or {}), insert=True)
        elif verb == UPDATE:
            writer.validate(values or {})
        if "valid" in self.model.axes(name) and start is None:
            raise WriteRejected("valid-window-missing", name)
        self.buffer.append(Instruction(verb, name, key, tuple((values or {}).items()), (start, until), observed))

    def _frame(self, entity: str, rows: list[Instruction]) -> DataFrame:
        pk = self.model.primary_key(entity)
        values = [dict(zip([a.name for a in pk], i.key, strict=True)) | dict(i.values) for i in rows]
        full = from_rows(self.spark, self.model, entity, values)
        df = full.select(*stored(self.model, entity, values[0]))
        if rows[0].observed is not None:
            # the gate stands beside the key it belongs to
            kind = T.TimestampNTZType() if self.model.axes(entity) else T.IntegerType()
            name = "observed_in" if self.model.axes(entity) else "observed_version"
            schema = T.StructType([T.StructField(a.column, full.schema[a.column].dataType) for a in pk] + [T.StructField(name, kind)])
            gates = self.spark.createDataFrame([(*i.key, i.observed) for i in rows], schema)
            df = df.join(gates, [a.column for a in pk])
        return df

    def apply(
        self, now: Callable[[], dt.datetime], check: bool = True, part: Callable[[str, DataFrame], DataFrame] | None = None
    ) -> dict[str, DataFrame]:
        """Table name to its new rows; tables that nothing touches are left out.

        The transaction instant is asked for only if a temporal write is left.
        ``part`` gives the rows of a table that instructions for some keys need;
        else that is the whole table.
        """
        tables: dict[str, DataFrame] = {}
        tx: dt.datetime | None = None
        work = [(verb, entity, rows, self._frame(entity, rows)) for verb, entity, rows in batches(self.model, coalesced(self.buffer))]
        needed: dict[str, DataFrame] = {}
        for _, entity, _, df in work:
            table, keys = self.model.table(entity), df.select(*[a.column for a in self.model.primary_key(entity)])
            needed[table] = needed[table].unionByName(keys) if table in needed else keys
        for verb, entity, rows, df in work:
            w, table = Writer(self.model, entity), self.model.table(entity)
            at = tables[table] if table in tables else part(table, needed[table]) if part else self.catalog.frame(table)
            axes, (start, until) = w.axes, rows[0].window
            if axes and tx is None:
                tx = now()
            if check and verb != INSERT:
                w.require(at, df, start, until)
            if not axes:
                tables[table] = {INSERT: w.insert, UPDATE: w.update, DELETE: w.delete}[verb](at, df)
            elif "valid" not in axes:
                tables[table] = {INSERT: w.tt_insert, UPDATE: w.tt_update, DELETE: w.tt_terminate}[verb](at, df, tx)
            elif verb == INSERT:
                tables[table] = w.bt_insert(at, df, tx, start, until)
            elif until is None:
                tables[table] = (w.bt_update if verb == UPDATE else w.bt_terminate)(at, df, tx, start)
            else:
                tables[table] = (w.bt_update_until if verb == UPDATE else w.bt_terminate_until)(at, df, tx, start, until)
        return tables

"""Writes as pure functions: a table and instructions give the new table.

History is append-only: a milestone is closed by its transaction end and never
rewritten otherwise. Each verb is one join of the table with its instructions
and one explode, so a table is scanned once however many rows a write makes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OptimisticConflict, StaleWrite, WriteRejected
from ..functions import documents as D
from ..model import TPH, Model, ValueObject
from ..sources.catalog import stored
from ..types import INFINITY, conforms, instant, literal
from .temporal import is_open

FROM, THRU, IN, OUT = "from_z", "thru_z", "in_z", "out_z"


class Writer:
    """The write verbs of one entity.

    Instructions are DataFrames with the entity's key columns and, for updates,
    the columns to assign; assigned nulls are nulls. A column ``observed_version``
    or ``observed_in`` gates a row on the version or milestone it was read at.
    """

    def __init__(self, model: Model, name: str) -> None:
        self.model, self.name = model, name
        e = model.entity(name)
        if e.inheritance is not None and e.inheritance.role != "concrete-subtype":
            raise WriteRejected("abstract-write-target", name)
        self.key = [a.column for a in model.primary_key(name)]
        self.columns = [c for c, _, _ in model.layout(name)]
        self.axes = model.axes(name)
        self.version = v.column if (v := model.version(name)) else None
        self.tag = model.root(name).inheritance.tag_column if model.strategy(name) == TPH else None

    # checks before anything runs

    def validate(self, values: Mapping[str, Any], insert: bool = False) -> None:
        """Member names, types and presence of one row's values."""
        m, name = self.model, self.name
        members = {a.name: a for a in m.attributes(name)}
        documents = {v.name: v for v in m.value_objects(name)}
        for k, v in values.items():
            if k in documents:
                _check(documents[k], v, k)
                continue
            if k not in members:
                family = {a.name for e in m.concretes(m.root(name).qualified) for a in m.attributes(e.qualified)}
                if k == self.tag or k == "familyVariant":
                    raise WriteRejected("subtype-write-metadata-field", k)
                raise WriteRejected("subtype-write-sibling-attribute" if k in family else "unknown-member", k)
            a = members[k]
            if v is None:
                if not a.nullable:
                    raise WriteRejected("write-required-attribute-missing", k)
            elif not conforms(v, a.type) or (a.max_length and len(v) > a.max_length):
                raise WriteRejected("write-value-type-mismatch", f"{k}: {v!r}")
            elif a.read_only and not insert:
                raise WriteRejected("write-read-only-attribute", k)
        if insert:
            for a in members.values():
                if not a.nullable and not a.pk_generation and not a.optimistic_locking and values.get(a.name) is None:
                    raise WriteRejected("write-required-attribute-missing", a.name)
            for v in documents.values():
                if not v.nullable and not v.many and values.get(v.name) is None:
                    raise WriteRejected("write-required-value-object-missing", v.name)

    def _assigned(self, changes: DataFrame) -> dict[str, Column]:
        """New values by column beside the row's old ones; a document takes up the members of the instruction's."""
        document = self.model.root(self.name).document
        names = [c for c in changes.columns if c in self.columns and c not in self.key]
        return {c: D.merged(F.col(c), F.col(f"_v_{c}")) if c == document else F.col(f"_v_{c}") for c in names}

    def _now(self) -> Column:
        """Whether a row is known now; without transaction time each one is."""
        return is_open(F.col(OUT)) if "transaction" in self.axes else F.lit(True)

    def _fill(self, new: DataFrame, extra: dict[str, Column]) -> DataFrame:
        own = dict(extra)
        if self.tag:
            own[self.tag] = F.lit(self.model.entity(self.name).inheritance.tag_value)
        if self.version:
            own.setdefault(self.version, F.lit(1).cast(dict((c, t) for c, t, _ in self.model.layout(self.name))[self.version]))
        types = {c: t for c, t, _ in self.model.layout(self.name)}
        return new.select(
            *[
                (own[c] if c in own else F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c)
                for c in self.columns
            ]
        )

    def _marked(self, table: DataFrame, changes: DataFrame, applies: Column, gated: bool = True) -> tuple[DataFrame, list[str]]:
        """The table with its instruction beside each row that one applies to (column ``_hit``)."""
        marks = [c for c in changes.columns if c not in self.key]
        side = changes.select(*[F.col(c).alias(f"_k_{c}") for c in self.key], *[F.col(c).alias(f"_v_{c}") for c in marks], F.lit(True).alias("_given"))
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in self.key])
        if self.tag:
            on = on & (F.col(self.tag) == F.lit(self.model.entity(self.name).inheritance.tag_value))
        df = table.join(side, on, "left")
        hit = F.coalesce(F.col("_given"), F.lit(False)) & applies
        if gated and "observed_version" in marks:
            hit = hit & (F.col(self.version) == F.col("_v_observed_version"))
        if gated and "observed_in" in marks:
            hit = hit & (F.col(IN) == F.col("_v_observed_in"))
        return df.withColumn("_hit", hit), marks

    # non-temporal

    def insert(self, table: DataFrame, new: DataFrame) -> DataFrame:
        return table.unionByName(self._fill(new, {}), allowMissingColumns=True)

    def update(self, table: DataFrame, changes: DataFrame) -> DataFrame:
        df, _ = self._marked(table, changes, F.lit(True))
        out = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in self._assigned(changes).items() if c != self.version}
        if self.version:
            out[self.version] = F.when(F.col("_hit"), F.col(self.version) + 1).otherwise(F.col(self.version))
        return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in table.columns])

    def delete(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        df, _ = self._marked(table, keys, F.lit(True))
        return df.where(~F.col("_hit")).select(*table.columns)

    def upsert(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        """Merge rows back that were read and changed elsewhere: known keys are updated, others inserted."""
        known = table.select(*self.key)
        return self.insert(self.update(table, rows), rows.join(known, self.key, "left_anti"))

    def purge(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        """The table without any trace of some keys, all their milestones included."""
        return table.join(keys.select(*self.key), self.key, "left_anti").select(*table.columns)

    def update_where(self, table: DataFrame, where: Column, assigned: Mapping[str, Column]) -> DataFrame:
        if self.model.entity(self.name).inheritance is not None:
            raise WriteRejected("subtype-write-set-based-unsupported", self.name)
        if missing := [c for c in assigned if c not in table.columns]:
            raise WriteRejected("unknown-member", f"{self.name}: {missing}")
        hit = F.coalesce(where, F.lit(False))
        out = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in assigned.items()}
        if self.version:
            out[self.version] = F.when(hit, F.col(self.version) + 1).otherwise(F.col(self.version))
        return table.select(*[out[c].alias(c) if c in out else F.col(c) for c in table.columns])

    def delete_where(self, table: DataFrame, where: Column) -> DataFrame:
        if self.model.entity(self.name).inheritance is not None:
            raise WriteRejected("subtype-write-set-based-unsupported", self.name)
        return table.where(~F.coalesce(where, F.lit(False)))

    # transaction time

    def tt_insert(self, table: DataFrame, new: DataFrame, tx: dt.datetime) -> DataFrame:
        return table.unionByName(self._fill(new, {IN: instant(tx), OUT: instant(INFINITY)}))

    def _milestones(self, table: DataFrame, df: DataFrame, tx: dt.datetime, successors: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
        """Rows as they were; those hit are closed and followed by the successors whose condition holds.

        Without transaction time there is nothing to close: successors take the place of what is hit.
        """

        def row(values: dict[str, Column]) -> Column:
            return F.struct(*[values.get(c, F.col(c)).alias(c) for c in table.columns])

        version = {self.version: F.col(self.version) + 1} if self.version else {}
        kept = "transaction" in self.axes
        fresh = {IN: instant(tx), OUT: instant(INFINITY), **version} if kept else version
        closed = F.array(row({OUT: instant(tx)} if kept else {}))
        none = F.filter(closed, lambda _: F.lit(False))
        closed = closed if kept else none
        parts = [F.when(when, F.array(row(values | fresh))).otherwise(none) for when, values in successors]
        rows = F.when(F.col("_hit"), F.concat(closed, *parts) if parts else closed).otherwise(F.array(row({})))
        return df.select(F.inline(rows))

    def tt_update(self, table: DataFrame, changes: DataFrame, tx: dt.datetime) -> DataFrame:
        """Close the current milestone and chain the next one."""
        df, _ = self._marked(table, changes, is_open(F.col(OUT)))
        return self._milestones(table, df, tx, [(F.lit(True), self._assigned(changes))])

    def tt_terminate(self, table: DataFrame, keys: DataFrame, tx: dt.datetime) -> DataFrame:
        df, _ = self._marked(table, keys, is_open(F.col(OUT)))
        return self._milestones(table, df, tx, [])

    def tt_update_where(self, table: DataFrame, where: Column, assigned: Mapping[str, Column], tx: dt.datetime) -> DataFrame:
        df = table.withColumn("_hit", F.coalesce(where, F.lit(False)) & is_open(F.col(OUT)))
        return self._milestones(table, df, tx, [(F.lit(True), dict(assigned))])

    def tt_terminate_where(self, table: DataFrame, where: Column, tx: dt.datetime) -> DataFrame:
        df = table.withColumn("_hit", F.coalesce(where, F.lit(False)) & is_open(F.col(OUT)))
        return self._milestones(table, df, tx, [])

    # both axes

    def bt_insert(self, table: DataFrame, new: DataFrame, tx: dt.datetime, start: dt.datetime, end: dt.datetime | None = None) -> DataFrame:
        if end is not None and not start < end:
            raise WriteRejected("valid-window-inverted", f"{start} {end}")
        bounds = {FROM: instant(start), THRU: instant(end or INFINITY)}
        if "transaction" in self.axes:
            bounds |= {IN: instant(tx), OUT: instant(INFINITY)}
        return table.unionByName(self._fill(new, bounds))

    def _split(
        self,
        table: DataFrame,
        df: DataFrame,
        tx: dt.datetime,
        start: Column,
        end: Column,
        middle: dict[str, Column] | None,
    ) -> DataFrame:
        """The rectangle split: head and tail keep the old state, the middle gets the new one, if any.

        Successors end where their predecessor ended; those without extent are left out.
        """
        parts = [(F.col(FROM) < start, {THRU: start})]
        if middle is not None:
            parts.append((start < end, {**middle, FROM: start, THRU: end}))
        parts.append((end < F.col(THRU), {FROM: end}))
        return self._milestones(table, df, tx, parts)

    def _keyed(self, table: DataFrame, changes: DataFrame, tx: dt.datetime, start: dt.datetime, end: dt.datetime | None, assign: bool) -> DataFrame:
        if end is not None and not start < end:
            raise WriteRejected("valid-window-inverted", f"{start} {end}")
        a = instant(start)
        inside = (F.col(FROM) <= a) & (F.col(THRU) > a)
        if end is not None:
            inside = inside & (F.col(THRU) >= instant(end))
        df, _ = self._marked(table, changes, self._now() & inside)
        b = instant(end) if end is not None else F.col(THRU)
        middle = self._assigned(changes) if assign else None
        return self._split(table, df, tx, a, b, middle)

    def bt_update(self, table: DataFrame, changes: DataFrame, tx: dt.datetime, start: dt.datetime) -> DataFrame:
        return self._keyed(table, changes, tx, start, None, True)

    def bt_update_until(self, table: DataFrame, changes: DataFrame, tx: dt.datetime, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """A correction within one current rectangle; windows that reach beyond it apply to no row (see ``unmatched``)."""
        return self._keyed(table, changes, tx, start, end, True)

    def bt_terminate(self, table: DataFrame, keys: DataFrame, tx: dt.datetime, start: dt.datetime) -> DataFrame:
        return self._keyed(table, keys, tx, start, None, False)

    def bt_terminate_until(self, table: DataFrame, keys: DataFrame, tx: dt.datetime, start: dt.datetime, end: dt.datetime) -> DataFrame:
        return self._keyed(table, keys, tx, start, end, False)

    def bt_where(
        self, table: DataFrame, where: Column, assigned: Mapping[str, Column] | None, tx: dt.datetime, start: dt.datetime, end: dt.datetime | None = None
    ) -> DataFrame:
        """A window over every current rectangle that meets a predicate, clipped to each; no values terminate."""
        stop = instant(end or INFINITY)
        over = self._now() & (F.col(FROM) < stop) & (F.col(THRU) > instant(start))
        df = table.withColumn("_hit", F.coalesce(where, F.lit(False)) & over)
        a, b = F.greatest(F.col(FROM), instant(start)), F.least(F.col(THRU), stop)
        return self._split(table, df, tx, a, b, dict(assigned) if assigned is not None else None)

    # affected rows

    def unmatched(self, table: DataFrame, changes: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """Instructions that apply to no row of the table."""
        applies = self._now()
        if start is not None:
            applies = applies & (F.col(FROM) <= instant(start)) & (F.col(THRU) > instant(start))
            applies = applies & (F.col(THRU) >= instant(end)) if end is not None else applies
        df, _ = self._marked(table, changes, applies)
        hit = df.where("_hit").select(*[F.col(f"_k_{c}").alias(c) for c in self.key])
        return changes.join(hit, self.key, "left_anti")

    def require(self, table: DataFrame, changes: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> None:
        """Raise unless every instruction applies: a conflict where it is gated, a stale write where it is not."""
        missing = self.unmatched(table, changes, start, end).limit(1).collect()
        if missing:
            gated = {"observed_version", "observed_in"} & set(changes.columns)
            raise (OptimisticConflict if gated else StaleWrite)(f"{self.name}: {missing[0].asDict()}")


def changed_only(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Updates without those that change nothing, compared null-safely with the rows they address."""
    assigned = [c for c in changes.columns if c not in key and c in table.columns]
    old = table.select(*key, *[F.col(c).alias(f"_o_{c}") for c in assigned])
    same = F.lit(True)
    for c in assigned:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return changes.join(old, key, "left").where(~same).select(*changes.columns).distinct()


def chained(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Transaction-time milestones from a log of states: each holds until the next one of its key."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(*key).orderBy(at)
    return events.withColumns({IN: F.col(at), OUT: F.coalesce(F.lead(at).over(by), instant(INFINITY))})


def assigned(model: Model, name: str, values: Mapping[str, Any]) -> dict[str, Column]:
    """New values by column: literals, composites as JSON, and the document with its members set."""
    kinds = {a.column: a.type for a in model.attributes(name)}
    document = model.root(name).document
    out = {}
    for c, v in stored(model, name, dict(values)).items():
        out[c] = D.merged(F.col(c), F.lit(v)) if c == document else literal(v, kinds.get(c, "string"))
    return out


def _check(v: ValueObject, value: Any, path: str, element: bool = False) -> None:
    """Reject a composite that does not fit its declaration, at any depth."""
    if v.many and not element:
        if value is not None and not isinstance(value, (list, tuple)):
            raise WriteRejected("write-value-type-mismatch", f"{path}: {value!r}")
        for n, x in enumerate(value or ()):
            _check(v, x, f"{path}[{n}]", True)
        return
    if value is None:
        if not v.nullable or element:
            raise WriteRejected("write-required-value-object-missing", path)
        return
    if not isinstance(value, dict):
        raise WriteRejected("write-value-type-mismatch", f"{path}: {value!r}")
    if unknown := set(value) - {m.name for m in v.members}:
        raise WriteRejected("unknown-member", f"{path}: {sorted(unknown)}")
    for m in v.members:
        at = f"{path}.{m.name}"
        if isinstance(m, ValueObject):
            _check(m, value.get(m.name), at)
        elif value.get(m.name) is None:
            if not m.nullable:
                raise WriteRejected("write-required-attribute-missing", at)
        elif not conforms(value[m.name], m.type) or (m.max_length and len(value[m.name]) > m.max_length):
            raise WriteRejected("write-value-type-mismatch", f"{at}: {value[m.name]!r}")

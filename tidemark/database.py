"""The front door: reads over a catalog, transactions over a store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import CardinalityCorruption, OptimisticConflict, WriteRejected
from .expr import Predicate, from_dict
from .graph import Node, graph
from .model import Model, ValueObject
from .operators import temporal
from .operators.fetch import flat
from .operators.writes import Writer, assigned
from .plans.compile import Compiler
from .plans.unitofwork import DELETE, INSERT, UPDATE, UnitOfWork
from .query import AggregateQuery, AsOf, History, Query
from .sources.catalog import Catalog
from .sources.store import Store
from .types import decoded, utc, wired


class Result:
    """A lazy result; nothing runs until it is asked for rows."""

    def __init__(self, df: DataFrame, model: Model | None = None, query: Query | None = None) -> None:
        self.df, self.model, self.query = df, model, query

    def results(self) -> list[Row]:
        return self.df.collect()

    def pages(self, size: int | None = None):
        """Rows one partition at a time, one by one or in lists of ``size``."""
        rows = self.df.toLocalIterator()
        return rows if size is None else iter(lambda: list(islice(rows, size)), [])

    def pin(self) -> dict[str, dt.datetime | None]:
        """The coordinates that were asked for, by axis; None is the latest."""
        chosen = temporal.effective(self.model.axes(self.query.target), dict(self.query.temporal))
        return {a: s.at if isinstance(s, AsOf) else None for a, s in chosen.items()}

    def graph(self) -> list[Node]:
        """Roots as nodes, one for each identity; see ``tidemark.graph`` for what can be asked of them."""
        return graph(self.model, self.query, self.results())

    def related(self, relationship: str) -> Result:
        """Rows of a relationship that was not fetched, read at the same coordinates, as pairs of parent and child."""
        return Result(self._flat(relationship))

    def result_or_none(self) -> Row | None:
        rows = self.df.limit(2).collect()
        if len(rows) > 1:
            raise CardinalityCorruption("more than one row")
        return rows[0] if rows else None

    def result(self) -> Row:
        row = self.result_or_none()
        if row is None:
            raise LookupError("no row")
        return row

    def wire(self) -> DataFrame:
        """Each row as one JSON text, leaves in their canonical forms."""
        row = [wired(self.df[f"`{f.name}`"], f.dataType).alias(f.name) for f in self.df.schema]
        return self.df.select(F.to_json(F.struct(*row)).alias("json"))


class Reads:
    def __init__(self, model: Model, catalog: Catalog) -> None:
        self.model, self.catalog = model, catalog

    def _compiler(self) -> Compiler:
        return Compiler(self.model, self.catalog)

    def find(self, q: Query) -> Result:
        c = self._compiler()
        out = Result(c.fetch(q) if q.includes else c.rows(q), self.model, q)
        out._flat = lambda relationship: flat(c, q, relationship)
        return out

    def read_rows(self, q: Query) -> Result:
        """Flat rows without value objects."""
        return Result(self._compiler().rows(q, documents=False))

    def find_history(self, q: Query) -> Result:
        c = self._compiler()
        return Result(c.fetch(q) if q.includes else c.history(q))

    def checked(self, q: Query) -> Result:
        """Rows with the issues of their stored data, available or not."""
        return Result(self._compiler().classified(q))

    def aggregate(self, q: AggregateQuery) -> Result:
        return Result(self._compiler().aggregate(q))

    def wire(self, body: dict[str, Any]) -> DataFrame:
        """A query in dictionary form, of rows or of aggregates; rows as JSON."""
        if "aggregates" in body:
            return self.aggregate(AggregateQuery.from_dict(self.model, body)).wire()
        return self.find(Query.from_dict(self.model, body)).wire()


class Transaction(Reads):
    """Keyed writes are buffered; reads and predicate writes see what was written before."""

    def __init__(self, spark: SparkSession, model: Model, catalog: Catalog, now: Callable[[], dt.datetime]) -> None:
        super().__init__(model, catalog)
        self.spark, self.touched = spark, {}
        #: of tables in buckets, the ones that ``touched`` holds
        self.parts: dict[str, set[int]] = {}
        self._now, self._tx = now, None
        self._work = UnitOfWork(spark, model, catalog)

    def instant(self) -> dt.datetime:
        """One transaction instant, taken when a temporal write first needs it."""
        if self._tx is None:
            self._tx = utc(self._now())
        return self._tx

    def flush(self) -> None:
        for table, df in self._work.apply(self.instant, part=self._part).items():
            self._put(table, df)
        self._work = UnitOfWork(self.spark, self.model, self.catalog)

    def _part(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a table whose bucket a key falls into, with those that were touched before."""
        kept = self.catalog.buckets.get(table)
        return self.catalog.frame(table) if kept is None else self._take(table, kept.touched(keys))

    def _take(self, table: str, numbers: set[int]) -> DataFrame:
        kept, before = self.catalog.buckets[table], self.parts.get(table, set())
        more = numbers - before
        self.parts[table] = before | numbers
        if table not in self.touched:
            return kept.frame(more)
        return self.touched[table].unionByName(kept.frame(more)) if more else self.touched[table]

    def _put(self, table: str, df: DataFrame) -> None:
        self.touched[table] = df
        kept = self.catalog.buckets.get(table)
        if kept is not None:
            rest = set(kept.paths) - self.parts[table]
            df = df.unionByName(kept.frame(rest)) if rest else df
        self.catalog = self.catalog.with_table(table, df)

    def _compiler(self) -> Compiler:
        self.flush()
        return super()._compiler()

    # keyed verbs

    def insert(self, entity: str, key: tuple, values: dict[str, Any], start: dt.datetime | None = None) -> None:
        self._work.add(INSERT, entity, key, values, start)

    def insert_until(self, entity: str, key: tuple, values: dict[str, Any], start: dt.datetime, until: dt.datetime) -> None:
        self._work.add(INSERT, entity, key, values, start, until)

    def update(self, entity: str, key: tuple, values: dict[str, Any], start: dt.datetime | None = None, observed: Any = None) -> None:
        self._work.add(UPDATE, entity, key, values, start, None, observed)

    def update_until(self, entity: str, key: tuple, values: dict[str, Any], start: dt.datetime, until: dt.datetime, observed: Any = None) -> None:
        self._work.add(UPDATE, entity, key, values, start, until, observed)

    def delete(self, entity: str, key: tuple, observed: Any = None) -> None:
        if self.model.axes(entity):
            raise WriteRejected("temporal-entity-has-no-delete", entity)
        self._work.add(DELETE, entity, key, observed=observed)

    def terminate(self, entity: str, key: tuple, start: dt.datetime | None = None, observed: Any = None) -> None:
        self._work.add(DELETE, entity, key, None, start, None, observed)

    def terminate_until(self, entity: str, key: tuple, start: dt.datetime, until: dt.datetime, observed: Any = None) -> None:
        self._work.add(DELETE, entity, key, None, start, until, observed)

    # the same in dictionary form

    def write(self, body: dict[str, Any]) -> None:
        """A write instruction: ``verb`` and ``entity`` with ``rows``, or with ``where`` and ``values``.

        A row holds the key by attribute name, the values, and ``observed`` where
        it is gated; ``validFrom`` and ``validUntil`` bound the valid time. On a
        temporal entity an instruction has one row.
        """
        verb, name = body["verb"], self.model.entity(body["entity"]).qualified
        start, until = (decoded(body[k], "timestamp") if body.get(k) else None for k in ("validFrom", "validUntil"))
        if "where" in body:
            values = None if verb in ("delete", "terminate") else self._decoded(name, body["values"])
            return self._where(name, from_dict(self.model, body["where"]), values, start, until)
        if len(body["rows"]) > 1 and self.model.axes(name):
            raise WriteRejected("temporal-keyed-write-multi-row", name)
        for row in body["rows"]:
            values = self._decoded(name, {k: v for k, v in row.items() if k != "observed"})
            key = tuple(values.pop(a.name) for a in self.model.primary_key(name))
            kind = {"insert": INSERT, "update": UPDATE, "delete": DELETE, "terminate": DELETE}[verb]
            if verb == "delete" and self.model.axes(name):
                raise WriteRejected("temporal-entity-has-no-delete", name)
            observed = row.get("observed")
            if observed is not None and self.model.axes(name):
                observed = decoded(observed, "timestamp")
            self._work.add(kind, name, key, values if kind != DELETE else None, start, until, observed)
        return None

    def _decoded(self, name: str, row: dict[str, Any]) -> dict[str, Any]:
        kinds = {a.name: a.type for a in self.model.attributes(name)}
        composites = {v.name: v for v in self.model.value_objects(name)}
        return {k: composites[k].decoded(v) if k in composites else decoded(v, kinds[k]) if k in kinds else v for k, v in row.items()}

    # predicate verbs

    def _where(self, entity: str, p: Predicate, values: dict[str, Any] | None, start=None, until=None) -> None:
        self.flush()
        name = self.model.entity(entity).qualified
        w, table = Writer(self.model, name), self.model.table(name)
        if values is not None:
            w.validate(values)
        c = Compiler(self.model, self.catalog)
        c.checker.predicate(p, name, {name})
        if not w.axes and w.version is None and any(isinstance(m, ValueObject) and m.many for n, m in self.model.resident(name).items() if n in (values or {})):
            raise WriteRejected("predicate-write-readless-document-many-unsupported", name)
        history = {a: History() for a in self.model.axes(name)}
        at = c.position(name, {name}, history)
        kept = self.catalog.buckets.get(table)
        if kept is not None:
            # only buckets that hold a row to write are written
            hit = at.df.where(at.lowering().lower(p)).select(*[at.col(k).alias(k) for k in kept.key])
            self.catalog = self.catalog.with_table(table, self._take(table, kept.touched(hit)))
            c = Compiler(self.model, self.catalog)
            at = c.position(name, {name}, history)
        where, new = at.lowering().lower(p), assigned(self.model, name, values or {})
        df = at.df
        if not w.axes:
            out = w.delete_where(df, where) if values is None else w.update_where(df, where, new)
        elif "valid" in w.axes:
            out = w.bt_where(df, where, None if values is None else new, self.instant(), start, until)
        elif values is None:
            out = w.tt_terminate_where(df, where, self.instant())
        else:
            out = w.tt_update_where(df, where, new, self.instant())
        self._put(table, out)

    def update_where(self, entity: str, p: Predicate, values: dict[str, Any], start: dt.datetime | None = None) -> None:
        self._where(entity, p, values, start)

    def delete_where(self, entity: str, p: Predicate) -> None:
        self._where(entity, p, None)

    def terminate_where(self, entity: str, p: Predicate, start: dt.datetime | None = None) -> None:
        self._where(entity, p, None, start)

    def update_until_where(self, entity: str, p: Predicate, values: dict[str, Any], start: dt.datetime, until: dt.datetime) -> None:
        self._where(entity, p, values, start, until)

    def terminate_until_where(self, entity: str, p: Predicate, start: dt.datetime, until: dt.datetime) -> None:
        self._where(entity, p, None, start, until)


class Database(Reads):
    """Reads of the last commit, and transactions that publish the next one."""

    def __init__(self, model: Model, store: Store, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)) -> None:
        self.store, self.now = store, now
        super().__init__(model, store.catalog())

    def transact(self, work: Callable[[Transaction], Any], attempts: int = 3) -> Any:
        """Run ``work``; on a lost race for the commit run it again over what the winner left."""
        for n in range(attempts):
            base = self.store.head()
            tx = Transaction(self.store.spark, self.model, self.store.catalog(base), self.now)
            out = work(tx)
            tx.flush()
            if not tx.touched:
                return out
            try:
                self.store.commit(tx.touched, base, touched=tx.parts)
            except OptimisticConflict:
                if n == attempts - 1 or self.store.head() == base:
                    raise
                continue
            self.catalog = self.store.catalog()
            return out
        return None

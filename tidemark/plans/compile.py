"""Query values as lazy DataFrames: filters, semi-joins, unions; Catalyst does the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import All, And, Group, Narrow, Not, Or, Predicate, Ref, Related
from ..functions import documents as D
from ..model import TPCS, TPH, Attribute, Model, SortKey, ValueObject
from ..operators import temporal
from ..operators.documents import JsonDoc, NativeDoc
from ..operators.predicates import Lowering
from ..query import AggregateQuery, Query, Selection
from ..sources.catalog import Catalog
from .validate import Checker, alternatives, covered, is_whole_family

VARIANT = "familyVariant"


def sort_column(col: Column, key: SortKey) -> Column:
    """Nulls are last in both directions unless the key says otherwise."""
    if key.descending:
        return col.desc_nulls_first() if key.nulls_first else col.desc_nulls_last()
    return col.asc_nulls_first() if key.nulls_first else col.asc_nulls_last()


class Position:
    """Rows of an entity position under an alias, with access to their members."""

    def __init__(self, compiler: Compiler, df: DataFrame, alias: str, name: str, active: set[str], chosen: dict[str, Selection]) -> None:
        self.compiler, self.alias, self.name, self.active, self.chosen = compiler, alias, name, active, chosen
        self.df = df.alias(alias)
        self.types = {f.name: f.dataType for f in df.schema}
        #: whether a predicate or limit chose the rows, so that related rows are looked up by their keys
        self.restricted = False
        #: documents that are parsed once for a whole predicate, by column
        self.parsed: dict[str, Column] = {}

    def col(self, column: str) -> Column:
        return F.col(f"{self.alias}.`{column}`")

    def variant(self, column: str) -> Column:
        return self.parsed[column] if column in self.parsed else D.variant(self.col(column))

    def _declaring(self, member: Attribute | ValueObject) -> set[str]:
        """The active concretes that have just this member: another variant's may share its path."""
        m = self.compiler.model
        return {c for c in self.active if member in (*m.attributes(c), *m.value_objects(c))}

    def attribute(self, a: Attribute) -> Column:
        root = self.compiler.model.root(self.name)
        if root.document and a.column not in self.types:
            leaf = D.leaf(self.variant(root.document), (a.name,), a.type)
            own = self._declaring(a)
            return leaf if own == self.active else F.when(self.is_one_of(own), leaf)
        return self.col(a.column)

    def document(self, v: ValueObject) -> JsonDoc | NativeDoc:
        root = self.compiler.model.root(self.name)
        if root.document and v.column not in self.types:
            doc, own = self.variant(root.document), self._declaring(v)
            return JsonDoc(doc if own == self.active else F.when(self.is_one_of(own), doc), (v.name,))
        kind = self.types[v.column]
        if isinstance(kind, T.StringType):
            return JsonDoc(self.variant(v.column))
        return JsonDoc(self.col(v.column)) if isinstance(kind, T.VariantType) else NativeDoc(self.col(v.column))

    def member(self, ref: Ref) -> Attribute | ValueObject:
        m = self.compiler.model
        return m.attribute(ref.entity, ref.path[0]) or m.value_object(ref.entity, ref.path[0])

    def is_one_of(self, concretes: set[str]) -> Column:
        m = self.compiler.model
        if m.strategy(self.name) == TPH:
            tags = [m.entity(c).inheritance.tag_value for c in sorted(concretes)]
            return self.col(m.root(self.name).inheritance.tag_column).isin(*tags)
        if m.strategy(self.name) == TPCS and VARIANT in self.types:
            return self.col(VARIANT).isin(*[m.entity(c).name for c in sorted(concretes)])
        return F.lit(bool(concretes & self.active))

    def lowering(self) -> Lowering:
        m = self.compiler.model
        return Lowering(
            self.member,
            self.attribute,
            self.document,
            lambda names: self.is_one_of(covered(m, names) & self.active),
            self.related,
        )

    def target(self, p: Related) -> tuple[Position, Column]:
        """The related rows that meet the operand, and what ties them to rows here."""
        m = self.compiler.model
        r = m.relationship(p.entity, p.relationship)
        within = alternatives(m, p.narrow, covered(m, (r.target,)), "narrow-outside-relationship-target")
        chosen = temporal.propagated(m.axes(r.target), self.chosen)
        child = self.compiler.position(r.target, within, chosen)
        child.df = child.filtered(p.operand)
        own, other = m.attribute(p.entity, r.join[0]), m.attribute(r.target, r.join[1])
        return child, (self.attribute(own), child.attribute(other))

    def related(self, p: Related) -> Column:
        """An existence test in any boolean position."""
        child, (own, other) = self.target(p)
        found = child.df.where(other == own.outer()).exists()
        return ~found if p.negated else found

    def _texts(self, p: Predicate) -> list[str]:
        """The columns of JSON text that a predicate reads, once for each place that does."""
        if isinstance(p, (And, Or)):
            return [c for x in p.operands for c in self._texts(x)]
        if isinstance(p, (Not, Group, Narrow)):
            return self._texts(p.operand)
        if isinstance(p, Related) or not hasattr(p, "ref"):
            return []
        member, document = self.member(p.ref), self.compiler.model.root(self.name).document
        if document and member.column not in self.types:
            return [document]
        return [member.column] if isinstance(member, ValueObject) and isinstance(self.types[member.column], T.StringType) else []

    def _once(self, parts: list[Predicate]) -> Column:
        """All parts as one condition for which each document is parsed once."""
        if not parts:
            return F.lit(True)
        texts = [c for p in parts for c in self._texts(p)]
        twice = sorted({c for c in texts if texts.count(c) > 1})

        def bound(left: list[str]) -> Column:
            if not left:
                return reduce(lambda a, b: a & b, map(self.lowering().lower, parts))

            def body(doc: Column) -> Column:
                self.parsed[left[0]] = doc
                try:
                    return F.coalesce(bound(left[1:]), F.lit(False))
                finally:
                    del self.parsed[left[0]]

            return F.exists(F.array(D.variant(self.col(left[0]))), body)

        return bound(twice)

    def filtered(self, p: Predicate) -> DataFrame:
        """Conjuncts one by one: existence tests become semi- and anti-joins, the rest plain filters.

        Conjuncts that read a document are one filter, which parses it once.
        """
        df = self.df
        parts = _conjuncts(p)
        nested = [x for x in parts if self._texts(x) and not _related(x)]
        parts = [x for x in parts if x not in nested]
        if len(nested) > 1 or len({*(c for x in nested for c in self._texts(x))}) < sum(len(self._texts(x)) for x in nested):
            df = df.where(self._once(nested))
        else:
            parts = [*nested, *parts]
        for part in parts:
            flip = False
            while isinstance(part, (Group, Not)) and isinstance(_inner(part), Related):
                flip ^= isinstance(part, Not)
                part = part.operand
            if isinstance(part, Related):
                child, (own, other) = self.target(part)
                df = df.join(child.df, own == other, "left_anti" if part.negated ^ flip else "left_semi")
            elif not isinstance(part, All):
                df = df.where(self.lowering().lower(part))
        return df


def _related(p: Predicate) -> bool:
    """Whether an existence test over a relationship stands anywhere in a predicate."""
    if isinstance(p, (And, Or)):
        return any(map(_related, p.operands))
    return isinstance(p, Related) or (isinstance(p, (Not, Group, Narrow)) and _related(p.operand))


def _inner(p: Predicate) -> Predicate:
    while isinstance(p, (Group, Not)):
        p = p.operand
    return p


def _conjuncts(p: Predicate) -> list[Predicate]:
    if isinstance(p, And):
        return [y for x in p.operands for y in _conjuncts(x)]
    if isinstance(p, Group) and isinstance(p.operand, (And, Group)):
        return _conjuncts(p.operand)
    return [p]


class Compiler:
    def __init__(self, model: Model, catalog: Catalog) -> None:
        self.model, self.catalog, self.checker = model, catalog, Checker(model)
        self._aliases = 0

    def _alias(self) -> str:
        self._aliases += 1
        return f"t{self._aliases - 1}"

    def _at(self, df: DataFrame, name: str, chosen: dict[str, Selection]) -> DataFrame:
        p = temporal.condition(lambda c: df[c], self.model.axes(name), chosen)
        return df if p is None else df.where(p)

    def position(self, name: str, active: set[str], chosen: dict[str, Selection]) -> Position:
        """Rows of the active concretes at the chosen coordinates.

        One table is scanned once with a tag test unless all of its family is
        meant; separate tables are united branch by branch, each filtered by
        time before the union and padded with typed nulls.
        """
        m = self.model
        strategy = m.strategy(name)
        polymorphic = m.entity(name).inheritance is not None and m.entity(name).inheritance.role != "concrete-subtype"
        if strategy == TPCS:
            branches = []
            for e in m.concretes(name):
                if e.qualified in active:
                    df = self._at(self.catalog.frame(m.table(e.qualified)), e.qualified, chosen)
                    columns = self._columns(df, e.qualified)
                    branches.append(df.select(*columns, *([F.lit(e.name).alias(VARIANT)] if polymorphic else [])))
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
            return Position(self, df, self._alias(), name, active, chosen)
        df = self._at(self.catalog.frame(m.table(name)), name, chosen)
        if strategy == TPH:
            tag = m.root(name).inheritance.tag_column
            if not is_whole_family(m, name, active):
                df = df.where(df[tag].isin(*[m.entity(c).inheritance.tag_value for c in sorted(active)]))
            if polymorphic:
                names = [x for e in m.concretes(name) for x in (F.lit(e.inheritance.tag_value), F.lit(e.name))]
                df = df.withColumn(VARIANT, F.element_at(F.create_map(*names), df[tag]))
        return Position(self, df, self._alias(), name, active, chosen)

    def _columns(self, df: DataFrame, name: str) -> list[str]:
        have = set(df.columns)
        return [c for c, _, _ in self.model.layout(name) if c in have]

    def columns(self, at: Position, documents: bool = True) -> list[str]:
        """Result columns: a function of model and position, never of the predicate."""
        m, out = self.model, []
        concretes = [e.qualified for e in m.concretes(at.name) if e.qualified in at.active]
        skip = set() if documents else {v.column for c in concretes for v in m.value_objects(c)} | {m.root(at.name).document}
        for c in concretes:
            out += [x for x, _, _ in m.layout(c) if x not in out and x not in skip and x in at.types]
        return out + ([VARIANT] if VARIANT in at.types else [])

    def roots(self, q: Query) -> Position:
        """The validated query's rows, ordered and limited, before projection."""
        active = self.checker.query(q)
        chosen = temporal.effective(self.model.axes(q.target), dict(q.temporal))
        at = self.position(q.target, active, chosen)
        at.df = at.filtered(q.predicate)
        at.restricted = not isinstance(q.predicate, All) or q.top is not None
        keys = [(self.model.attribute(sorted(active)[0], k.attribute), k) for k in q.sort]
        order = [sort_column(at.attribute(a), k) for a, k in keys]
        if q.top is not None:
            # a total order: the same rows whenever the plan is run, also where keys tie
            order += [at.col(c) for c in self.model.physical_key(q.target) if c in at.types]
        if order:
            at.df = at.df.orderBy(*order)
        if q.top is not None:
            at.df = at.df.limit(q.top)
        return at

    def rows(self, q: Query, documents: bool = True) -> DataFrame:
        """Flat rows: one column for each stored column, and the variant of polymorphic positions."""
        at = self.roots(q)
        return at.df.select(*[at.col(c).alias(c) for c in self.columns(at, documents)])

    def history(self, q: Query) -> DataFrame:
        """Rows with each milestone's own coordinates (``edge``) and those asked for (``pin``)."""
        at = self.roots(q)
        axes = self.model.axes(q.target)
        extra = [temporal.edge(at.col, axes).alias("edge"), temporal.pin(axes, at.chosen).alias("pin")] if axes else []
        return at.df.select(*[at.col(c).alias(c) for c in self.columns(at)], *extra)

    def aggregate(self, q: AggregateQuery) -> DataFrame:
        from ..operators.aggregate import aggregated

        self.checker.aggregate(q)
        at = self.roots(Query(q.source.target, q.source.predicate, q.source.narrow_to, q.source.temporal))
        first = sorted(at.active)[0]
        return aggregated(at.df, q, lambda name: at.attribute(self.model.attribute(first, name)))

    def classified(self, q: Query) -> DataFrame:
        """Rows with the issues of their stored data."""
        from ..operators.classify import classified

        return classified(self, q)

    def fetch(self, q: Query) -> DataFrame:
        from ..operators.fetch import fetched

        return fetched(self, q)



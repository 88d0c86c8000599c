"""The closed, declared model: entities, attributes, relationships, value objects, families."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import types as T

from .errors import ModelRejected, QueryRejected
from .types import decoded, document_value, spark_type

#: Fixed values here and in the checks below: names of axes, temporalities, strategies, roles, cardinalities and rules.
VALID, TRANSACTION = "valid", "transaction"
#: The fixed interval columns of each axis.
AXIS_COLUMNS = {VALID: ("from_z", "thru_z"), TRANSACTION: ("in_z", "out_z")}
AXES = {"nontemporal": (), "transaction-time": (TRANSACTION,), "valid-time": (VALID,), "bitemporal": (VALID, TRANSACTION)}
TPH, TPCS = "table-per-hierarchy", "table-per-concrete-subtype"


def default_column(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    column: str = ""
    primary_key: bool = False
    nullable: bool = False
    max_length: int | None = None
    read_only: bool = False
    optimistic_locking: bool = False
    pk_generation: str | None = None

    def __post_init__(self) -> None:
        spark_type(self.type)
        if not self.column:
            object.__setattr__(self, "column", default_column(self.name))


@dataclass(frozen=True)
class ValueObject:
    """A typed composite stored in one JSON column, or native as struct or array of structs."""

    name: str
    members: tuple[Attribute | ValueObject, ...]
    multiplicity: str = "one"
    column: str = ""
    nullable: bool = True

    def __post_init__(self) -> None:
        if not self.column:
            object.__setattr__(self, "column", default_column(self.name))

    @property
    def many(self) -> bool:
        return self.multiplicity == "many"

    def member(self, name: str) -> Attribute | ValueObject | None:
        return next((m for m in self.members if m.name == name), None)

    def encoded(self, value: Any) -> Any:
        """A composite (dictionary, or list of them) as it stands in a JSON document; a missing list is an empty one."""
        if self.many:
            return [self._encoded(x) for x in value or ()]
        return None if value is None else self._encoded(value)

    def decoded(self, value: Any) -> Any:
        """The composite of a JSON document's values, leaves by their declared types; of another shape as it is."""
        if isinstance(value, list):
            return [self.decoded(x) for x in value]
        if not isinstance(value, dict):
            return value
        own = {m.name: m for m in self.members}
        return {
            k: v if k not in own else own[k].decoded(v) if isinstance(own[k], ValueObject) else decoded(v, own[k].type)
            for k, v in value.items()
        }

    def _encoded(self, value: dict[str, Any]) -> dict[str, Any]:
        own = {m.name: m for m in self.members}
        return {k: own[k].encoded(v) if isinstance(own[k], ValueObject) else document_value(v, own[k].type) for k, v in value.items()}


@dataclass(frozen=True)
class SortKey:
    attribute: str
    descending: bool = False
    nulls_first: bool = False

    def nulls(self, first: bool) -> SortKey:
        return replace(self, nulls_first=first)


@dataclass(frozen=True)
class Relationship:
    """Defining side: ``join`` = (own attribute, target's attribute). Reverse side: ``reverse_of`` = target's relationship."""

    name: str
    target: str
    join: tuple[str, str] | None = None
    cardinality: str = "one-to-many"
    dependent: bool = False
    order_by: tuple[SortKey, ...] = ()
    reverse_of: str | None = None

    @property
    def to_many(self) -> bool:
        return self.cardinality.endswith("-many")


_INVERSE = {"one-to-many": "many-to-one", "many-to-one": "one-to-many", "one-to-one": "one-to-one"}


@dataclass(frozen=True)
class Inheritance:
    role: str  # root, abstract-subtype, concrete-subtype
    parent: str | None = None
    strategy: str | None = None
    tag_column: str | None = None
    tag_value: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    attributes: tuple[Attribute, ...] = ()
    table: str | None = None
    relationships: tuple[Relationship, ...] = ()
    value_objects: tuple[ValueObject, ...] = ()
    temporality: str = "nontemporal"
    inheritance: Inheritance | None = None
    namespace: str = ""
    document: str | None = None  # column of the document layout
    unique: tuple[tuple[str, ...], ...] = ()

    @property
    def qualified(self) -> str:
        return f"{self.namespace}.{self.name}" if self.namespace else self.name


class Model:
    """A validated set of entities with everything derived from it."""

    def __init__(self, *entities: Entity) -> None:
        self.entities = {e.qualified: e for e in entities}
        if len(self.entities) != len(entities):
            raise ModelRejected("metamodel-entity-identity-duplicate")
        _check_families(self)
        _check_entities(self)

    def entity(self, name: str) -> Entity:
        if name in self.entities:
            return self.entities[name]
        found = [e for e in self.entities.values() if e.name == name]
        if len(found) > 1:
            raise QueryRejected("reference-ambiguous-entity-name", name)
        if not found:
            raise QueryRejected("reference-unknown-entity", name)
        return found[0]

    def __iter__(self) -> Iterator[Entity]:
        return iter(self.entities.values())

    # families

    def ancestry(self, name: str) -> list[Entity]:
        """The entity and its ancestors, root last."""
        out = [self.entity(name)]
        while (h := out[-1].inheritance) and h.parent:
            out.append(self.entity(h.parent))
        return out

    def root(self, name: str) -> Entity:
        return self.ancestry(name)[-1]

    def children(self, name: str) -> list[Entity]:
        own = self.entity(name).qualified
        return [e for e in self if e.inheritance and e.inheritance.parent and self.entity(e.inheritance.parent).qualified == own]

    def concretes(self, name: str) -> list[Entity]:
        """The concrete entities at or below ``name``, in declaration order."""
        e = self.entity(name)
        if e.inheritance is None or e.inheritance.role == "concrete-subtype":
            return [e]
        below = {c.qualified for k in self.children(name) for c in self.concretes(k.qualified)}
        return [c for c in self if c.qualified in below]

    def strategy(self, name: str) -> str | None:
        h = self.root(name).inheritance
        return h.strategy if h else None

    def attributes(self, name: str) -> tuple[Attribute, ...]:
        """Own and inherited attributes, root's first."""
        return tuple(a for e in reversed(self.ancestry(name)) for a in e.attributes)

    def relationships(self, name: str) -> tuple[Relationship, ...]:
        return tuple(r for e in reversed(self.ancestry(name)) for r in e.relationships)

    def value_objects(self, name: str) -> tuple[ValueObject, ...]:
        return tuple(v for e in reversed(self.ancestry(name)) for v in e.value_objects)

    def axes(self, name: str) -> tuple[str, ...]:
        return AXES[self.root(name).temporality]

    def primary_key(self, name: str) -> tuple[Attribute, ...]:
        return tuple(a for a in self.attributes(name) if a.primary_key)

    def version(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes(name) if a.optimistic_locking), None)

    def attribute(self, name: str, attribute: str) -> Attribute | None:
        return next((a for a in self.attributes(name) if a.name == attribute), None)

    def value_object(self, name: str, member: str) -> ValueObject | None:
        return next((v for v in self.value_objects(name) if v.name == member), None)

    def table(self, name: str) -> str:
        e = self.entity(name)
        t = e.table or (self.root(name).table if self.strategy(name) == TPH else None)
        return t or default_column(e.name)

    # relationships

    def relationship(self, name: str, relationship: str) -> Relationship | None:
        """The relationship with its join and cardinality, derived where it is a reverse side."""
        r = next((r for r in self.relationships(name) if r.name == relationship), None)
        if r is None or r.reverse_of is None:
            return r
        other = next(x for x in self.relationships(r.target) if x.name == r.reverse_of)
        return replace(r, join=(other.join[1], other.join[0]), cardinality=_INVERSE[other.cardinality])

    def is_inverse(self, name: str, first: str, second: str) -> bool:
        """Whether ``second`` leads back over ``first``, so that its result is known."""
        a = self.relationship(name, first)
        b = next((r for r in self.relationships(a.target) if r.name == second), None)
        raw = next(r for r in self.relationships(name) if r.name == first)
        return b is not None and (b.reverse_of == first or raw.reverse_of == second)

    # storage

    def layout(self, name: str) -> list[tuple[str, T.DataType, bool]]:
        """(column, type, nullable) in the order identity, tag, domain, temporal, audit, document."""
        e, root, out = self.entity(name), self.root(name), []
        attrs = self.attributes(name)
        out += [(a.column, spark_type(a.type), False) for a in attrs if a.primary_key]
        if self.strategy(name) == TPH:
            out.append((root.inheritance.tag_column, T.StringType(), False))
        ends = self._join_members(e.qualified)
        resident = [a for a in attrs if not a.primary_key and not a.optimistic_locking]
        if root.document:
            resident = [a for a in resident if a.name in ends]
        out += [(a.column, spark_type(a.type), a.nullable) for a in resident]
        for axis in self.axes(name):
            out += [(c, T.TimestampNTZType(), False) for c in AXIS_COLUMNS[axis]]
        out += [(a.column, spark_type(a.type), False) for a in attrs if a.optimistic_locking]
        out += [(root.document, T.StringType(), True)] if root.document else [(v.column, T.StringType(), v.nullable) for v in self.value_objects(name)]
        return out

    def _join_members(self, name: str) -> set[str]:
        out = set()
        own = {e.qualified for e in self.ancestry(name)}
        for e in self:
            for r in e.relationships:
                full = self.relationship(e.qualified, r.name)
                if e.qualified in own:
                    out.add(full.join[0])
                if self.entity(r.target).qualified in own:
                    out.add(full.join[1])
        return out

    def resident(self, name: str) -> dict[str, Attribute | ValueObject]:
        """The members that stand in the document of a document layout, by name; none elsewhere."""
        if not self.root(name).document:
            return {}
        ends = self._join_members(self.entity(name).qualified)
        own = [a for a in self.attributes(name) if not a.primary_key and not a.optimistic_locking and a.name not in ends]
        return {m.name: m for m in (*own, *self.value_objects(name))}

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(c, t, n) for c, t, n in self.layout(name)])

    def physical_key(self, name: str) -> list[str]:
        """Primary key columns and the upper bound of each axis."""
        return [a.column for a in self.primary_key(name)] + [AXIS_COLUMNS[x][1] for x in self.axes(name)]

    @cached_property
    def ref(self):
        from .expr import Refs

        return Refs(self)


def _check_families(model: Model) -> None:
    for e in model:
        h = e.inheritance
        if h is None:
            continue
        if h.role == "root":
            if h.parent:
                raise ModelRejected("inheritance-missing-root", e.name)
            if h.strategy not in (TPH, TPCS):
                raise ModelRejected("inheritance-missing-root", f"{e.name} names no strategy")
            if h.strategy == TPCS and e.table:
                raise ModelRejected("inheritance-tpcs-abstract-table-forbidden", e.name)
            if h.strategy == TPCS and h.tag_column:
                raise ModelRejected("inheritance-tag-on-concrete-subtype-strategy", e.name)
            continue
        seen, at = {e.qualified}, e
        while at.inheritance and at.inheritance.parent:
            parent = next((x for x in model if at.inheritance.parent in (x.name, x.qualified)), None)
            if parent is None:
                raise ModelRejected("inheritance-unknown-parent", at.inheritance.parent)
            if parent.qualified in seen:
                raise ModelRejected("inheritance-cycle", e.name)
            seen.add(parent.qualified)
            at = parent
        if at.inheritance is None or at.inheritance.role != "root":
            rule = "inheritance-concrete-without-abstract-root" if h.role == "concrete-subtype" else "inheritance-missing-root"
            raise ModelRejected(rule, e.name)
        if h.strategy:
            raise ModelRejected("inheritance-strategy-redeclared", e.name)
        if e.temporality != "nontemporal":
            raise ModelRejected("inheritance-temporality-not-root-owned", e.name)
        if e.document:
            raise ModelRejected("inheritance-layout-not-root-owned", e.name)
        if any(a.optimistic_locking for a in e.attributes):
            raise ModelRejected("inheritance-optimistic-locking-not-root-owned", e.name)
        strategy = at.inheritance.strategy
        if strategy == TPH and e.table:
            raise ModelRejected("inheritance-tph-descendant-table-forbidden", e.name)
        if strategy == TPCS and h.role == "abstract-subtype" and e.table:
            raise ModelRejected("inheritance-tpcs-abstract-table-forbidden", e.name)
        if strategy == TPCS and h.tag_value is not None:
            raise ModelRejected("inheritance-tag-on-concrete-subtype-strategy", e.name)
        if strategy == TPH and h.role == "concrete-subtype" and h.tag_value is None:
            raise ModelRejected("inheritance-missing-tag-value", e.name)
    for e in model:
        if e.inheritance and e.inheritance.role == "root":
            leaves = model.concretes(e.qualified)
            if not leaves:
                raise ModelRejected("inheritance-missing-concrete-subtype", e.name)
            tags = [x.inheritance.tag_value for x in leaves if x.inheritance.tag_value is not None]
            if len(set(tags)) != len(tags):
                raise ModelRejected("inheritance-duplicate-tag-value", e.name)
            for x in leaves:
                if any(m.name == "familyVariant" or m.column == "familyVariant" for m in model.attributes(x.qualified)):
                    raise ModelRejected("inheritance-materialization-key-collision", x.name)


def _check_entities(model: Model) -> None:
    tables: dict[str, str] = {}
    for e in model:
        abstract = e.inheritance is not None and e.inheritance.role != "concrete-subtype"
        if not abstract:
            columns = [c for c, _, _ in model.layout(e.qualified)]
            if len(set(columns)) != len(columns):
                raise ModelRejected("storage-layout-column-collision", e.name)
            table, owner = model.table(e.qualified), model.root(e.qualified).qualified if model.strategy(e.qualified) == TPH else e.qualified
            if tables.setdefault(table, owner) != owner:
                raise ModelRejected("storage-layout-table-mapping-collision", table)
            if not model.primary_key(e.qualified):
                raise ModelRejected("entity-without-primary-key", e.name)
        if len(set(e.unique)) != len(e.unique):
            raise ModelRejected("metamodel-index-identity-duplicate", e.name)
        if e.document:
            resident = {a.name for a in e.attributes if not a.primary_key and not a.optimistic_locking} - model._join_members(e.qualified)
            for a in e.attributes:
                if a.name in resident and a.column != default_column(a.name):
                    raise ModelRejected("storage-layout-document-member-column-override", a.name)
            if any(m in resident for key in e.unique for m in key):
                raise ModelRejected("storage-layout-index-over-document-member", e.name)
        for r in e.relationships:
            target = model.entity(r.target)
            if r.reverse_of is None:
                if r.cardinality not in _INVERSE or r.join is None:
                    raise ModelRejected("relationship-cardinality", r.name)
                if model.attribute(e.qualified, r.join[0]) is None or model.attribute(target.qualified, r.join[1]) is None:
                    raise ModelRejected("relationship-join-attribute", r.name)
            elif all(x.name != r.reverse_of or x.reverse_of for x in model.relationships(target.qualified)):
                raise ModelRejected("relationship-reverse-of", r.name)

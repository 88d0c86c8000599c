"""Predicates as an immutable tree, the references that build them, and their dictionary form.

Fixed values: the names of nodes in dictionary form are the spelling of the interchange form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from .errors import QueryRejected
from .model import SortKey

if TYPE_CHECKING:
    from .model import Model


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(_flat(And, self) + _flat(And, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or(_flat(Or, self) + _flat(Or, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def grouped(self) -> Predicate:
        return Group(self)


def _flat(kind: type, p: Predicate) -> tuple[Predicate, ...]:
    return p.operands if isinstance(p, kind) else (p,)


@dataclass(frozen=True)
class Ref:
    """A member: of an entity, or of an element inside a scoped test (entity is None).

    A path of several names goes through value objects.
    """

    entity: str | None
    path: tuple[str, ...]

    @property
    def nested(self) -> bool:
        return self.entity is None or len(self.path) > 1


@dataclass(frozen=True)
class All(Predicate):
    pass


@dataclass(frozen=True)
class Nothing(Predicate):
    pass


@dataclass(frozen=True)
class Compare(Predicate):
    op: str  # eq, notEq, greaterThan, greaterThanEquals, lessThan, lessThanEquals
    ref: Ref
    value: Any


@dataclass(frozen=True)
class Between(Predicate):
    ref: Ref
    low: Any
    high: Any


@dataclass(frozen=True)
class NullTest(Predicate):
    ref: Ref
    negated: bool = False


@dataclass(frozen=True)
class Match(Predicate):
    op: str  # like, notLike, startsWith, endsWith, contains
    ref: Ref
    value: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Member(Predicate):
    ref: Ref
    values: tuple[Any, ...]
    negated: bool = False


@dataclass(frozen=True)
class And(Predicate):
    operands: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    operands: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    operand: Predicate


@dataclass(frozen=True)
class Group(Predicate):
    operand: Predicate


@dataclass(frozen=True)
class Narrow(Predicate):
    """Rows of the given subtypes that meet the operand."""

    subtypes: tuple[str, ...]
    operand: Predicate = field(default_factory=All)


@dataclass(frozen=True)
class Related(Predicate):
    """Whether a related row exists that meets the operand."""

    entity: str
    relationship: str
    operand: Predicate = field(default_factory=All)
    negated: bool = False
    narrow: tuple[str, ...] = ()


@dataclass(frozen=True)
class Holds(Predicate):
    """Whether a value object is present (one) or has an element (many) that meets the operand."""

    ref: Ref
    operand: Predicate | None = None
    negated: bool = False


# ---- authoring


class MemberRef:
    """``Order.price`` or ``Customer.address.city``: comparisons give predicates."""

    def __init__(self, model: Model, entity: str | None, path: tuple[str, ...], shape: Any) -> None:
        self._model, self._entity, self._path, self._shape = model, entity, path, shape

    @property
    def ref(self) -> Ref:
        return Ref(self._entity, self._path)

    def __getattr__(self, name: str) -> MemberRef:
        if name.startswith("_"):
            raise AttributeError(name)
        member = self._shape.member(name) if hasattr(self._shape, "member") else None
        if member is None:
            raise AttributeError(f"{'.'.join(self._path)} has no member {name}")
        return MemberRef(self._model, self._entity, (*self._path, name), member)

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare("eq", self.ref, value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare("notEq", self.ref, value)

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, value: Any) -> Predicate:
        return Compare("greaterThan", self.ref, value)

    def __ge__(self, value: Any) -> Predicate:
        return Compare("greaterThanEquals", self.ref, value)

    def __lt__(self, value: Any) -> Predicate:
        return Compare("lessThan", self.ref, value)

    def __le__(self, value: Any) -> Predicate:
        return Compare("lessThanEquals", self.ref, value)

    def between(self, low: Any, high: Any) -> Predicate:
        return Between(self.ref, low, high)

    def is_(self, value: bool | None) -> Predicate:
        return NullTest(self.ref) if value is None else Compare("eq", self.ref, value)

    def is_null(self) -> Predicate:
        return NullTest(self.ref)

    def is_not_null(self) -> Predicate:
        return NullTest(self.ref, negated=True)

    def in_(self, values: Any) -> Predicate:
        return Member(self.ref, tuple(values))

    def not_in(self, values: Any) -> Predicate:
        return Member(self.ref, tuple(values), negated=True)

    def like(self, pattern: str, ignore_case: bool = False) -> Predicate:
        return Match("like", self.ref, pattern, ignore_case)

    def not_like(self, pattern: str, ignore_case: bool = False) -> Predicate:
        return Match("notLike", self.ref, pattern, ignore_case)

    def starts_with(self, text: str, ignore_case: bool = False) -> Predicate:
        return Match("startsWith", self.ref, text, ignore_case)

    def ends_with(self, text: str, ignore_case: bool = False) -> Predicate:
        return Match("endsWith", self.ref, text, ignore_case)

    def contains(self, text: str, ignore_case: bool = False) -> Predicate:
        return Match("contains", self.ref, text, ignore_case)

    def exists(self, where: Callable[[MemberRef], Predicate] | None = None) -> Predicate:
        """Presence of a value object; with ``where``, one element that meets all of it."""
        return Holds(self.ref, where(MemberRef(self._model, None, (), self._shape)) if where else None)

    def not_exists(self, where: Callable[[MemberRef], Predicate] | None = None) -> Predicate:
        return Holds(self.ref, where(MemberRef(self._model, None, (), self._shape)) if where else None, negated=True)

    def asc(self) -> SortKey:
        return SortKey(self._path[-1])

    def desc(self) -> SortKey:
        return SortKey(self._path[-1], descending=True)

    def set(self, value: Any) -> tuple[str, Any]:
        return self._path[0], value


class PathRef:
    """``Order.items`` and longer chains of relationships."""

    def __init__(self, model: Model, entity: str, hops: tuple[tuple[str, tuple[str, ...]], ...], owners: tuple[str, ...]) -> None:
        self._model, self._entity, self._hops, self._owners = model, entity, hops, owners

    def _target(self) -> str:
        name, narrowed = self._hops[-1]
        return narrowed[0] if len(narrowed) == 1 else self._model.relationship(self._owners[-1], name).target

    def __getattr__(self, name: str) -> PathRef:
        if name.startswith("_"):
            raise AttributeError(name)
        target = self._target()
        if self._model.relationship(target, name) is None:
            raise AttributeError(f"{target} has no relationship {name}")
        return PathRef(self._model, self._entity, (*self._hops, (name, ())), (*self._owners, target))

    def narrow(self, *subtypes: Any) -> PathRef:
        names = tuple(s if isinstance(s, str) else s._name for s in subtypes)
        return PathRef(self._model, self._entity, (*self._hops[:-1], (self._hops[-1][0], names)), self._owners)

    def _test(self, operand: Predicate | None, negated: bool) -> Predicate:
        out = operand or All()
        for i in range(len(self._hops) - 1, -1, -1):
            name, narrowed = self._hops[i]
            out = Related(self._owners[i], name, out, negated and i == 0, narrowed)
        return out

    def exists(self, operand: Predicate | None = None) -> Predicate:
        return self._test(operand, False)

    def not_exists(self, operand: Predicate | None = None) -> Predicate:
        return self._test(operand, True)


class EntityRef:
    def __init__(self, model: Model, name: str) -> None:
        self._model, self._name = model, model.entity(name).qualified

    def __getattr__(self, name: str) -> MemberRef | PathRef:
        if name.startswith("_"):
            raise AttributeError(name)
        m = self._model
        for e in [self._name, *[c.qualified for c in m.concretes(self._name)]]:
            if a := m.attribute(e, name) or m.value_object(e, name):
                return MemberRef(m, e, (name,), a)
            if m.relationship(e, name):
                return PathRef(m, e, ((name, ()),), (e,))
        raise AttributeError(f"{self._name} has no member {name}")

    def narrowed(self, operand: Predicate | None = None) -> Predicate:
        return Narrow((self._name,), operand or All())

    def where(self, *predicates: Predicate):
        from .query import Query

        return Query(self._name).where(*predicates)


class Refs:
    def __init__(self, model: Model) -> None:
        self._model = model

    def __getattr__(self, name: str) -> EntityRef:
        if name.startswith("_"):
            raise AttributeError(name)
        return EntityRef(self._model, name)


# ---- dictionary form

_COMPARE = ("eq", "notEq", "greaterThan", "greaterThanEquals", "lessThan", "lessThanEquals")
_NESTED = dict(zip(_COMPARE, ("nestedEq", "nestedNotEq", "nestedGt", "nestedGte", "nestedLt", "nestedLte"), strict=True))
_MATCH = ("like", "notLike", "startsWith", "endsWith", "contains")


def _nest(name: str) -> str:
    return "nested" + name[0].upper() + name[1:]


def _key(name: str, ref: Ref) -> str:
    if not ref.nested:
        return name
    return _NESTED.get(name) or _nest(name)


def _path(ref: Ref) -> str:
    return ".".join(([ref.entity] if ref.entity else []) + list(ref.path))


def to_dict(p: Predicate) -> dict[str, Any]:
    """One key, the node's name, with its content."""
    match p:
        case All():
            return {"all": {}}
        case Nothing():
            return {"none": {}}
        case Compare(op, ref, value):
            return {_key(op, ref): {"attribute": _path(ref), "value": value}}
        case Between(ref, low, high):
            return {_key("between", ref): {"attribute": _path(ref), "lower": low, "upper": high}}
        case NullTest(ref, negated):
            return {_key("isNotNull" if negated else "isNull", ref): {"attribute": _path(ref)}}
        case Match(op, ref, value, ignore_case):
            out = {"attribute": _path(ref), "value": value}
            return {_key(op, ref): out | ({"caseInsensitive": True} if ignore_case else {})}
        case Member(ref, values, negated):
            return {_key("notIn" if negated else "in", ref): {"attribute": _path(ref), "values": list(values)}}
        case And(operands):
            return {"and": [to_dict(x) for x in operands]}
        case Or(operands):
            return {"or": [to_dict(x) for x in operands]}
        case Not(operand):
            return {"not": to_dict(operand)}
        case Group(operand):
            return {"group": to_dict(operand)}
        case Narrow(subtypes, operand):
            return {"narrow": {"to": list(subtypes), "predicate": to_dict(operand)}}
        case Related(entity, relationship, operand, negated, narrow):
            out = {"relationship": f"{entity}.{relationship}", "predicate": to_dict(operand)}
            return {"notExists" if negated else "exists": out | ({"narrow": list(narrow)} if narrow else {})}
        case Holds(ref, operand, negated):
            out = {"path": _path(ref)} | ({"where": to_dict(operand)} if operand else {})
            return {"nestedNotExists" if negated else "nestedExists": out}
    raise TypeError(p)


def from_dict(model: Model, node: dict[str, Any], scoped: bool = False) -> Predicate:
    if len(node) != 1:
        raise QueryRejected("predicate-node-shape", str(sorted(node)))
    (name, body), = node.items()

    def ref(text: str) -> Ref:
        parts = text.split(".")
        if scoped:
            return Ref(None, tuple(parts))
        for n in range(1, len(parts)):
            if (e := ".".join(parts[:n])) in model.entities:
                return Ref(e, tuple(parts[n:]))
        return Ref(model.entity(parts[0]).qualified, tuple(parts[1:]))

    plain = {v: k for k, v in _NESTED.items()} | {_nest(k): k for k in (*_MATCH, "between", "isNull", "isNotNull", "in", "notIn")}
    kind = plain.get(name, name)
    if kind in ("all", "none"):
        return All() if kind == "all" else Nothing()
    if kind in ("and", "or"):
        parts = tuple(from_dict(model, x, scoped) for x in body)
        if len(parts) < 2:
            raise QueryRejected("connective-needs-two-operands", kind)
        return And(parts) if kind == "and" else Or(parts)
    if kind in ("not", "group"):
        return (Not if kind == "not" else Group)(from_dict(model, body, scoped))
    if kind in _COMPARE:
        return Compare(kind, ref(body["attribute"]), body["value"])
    if kind == "between":
        return Between(ref(body["attribute"]), body["lower"], body["upper"])
    if kind in ("isNull", "isNotNull"):
        return NullTest(ref(body["attribute"]), kind == "isNotNull")
    if kind in _MATCH:
        return Match(kind, ref(body["attribute"]), body["value"], body.get("caseInsensitive", False))
    if kind in ("in", "notIn"):
        return Member(ref(body["attribute"]), tuple(body["values"]), kind == "notIn")
    if kind == "narrow":
        return Narrow(tuple(body["to"]), from_dict(model, body.get("predicate", {"all": {}})))
    if kind in ("exists", "notExists", "navigate"):
        r = ref(body["relationship"])
        inner = from_dict(model, body.get("predicate", {"all": {}}))
        return Related(r.entity, r.path[0], inner, kind == "notExists", tuple(body.get("narrow", ())))
    if kind in ("nestedExists", "nestedNotExists"):
        inner = from_dict(model, body["where"], scoped=True) if "where" in body else None
        return Holds(ref(body["path"]), inner, kind == "nestedNotExists")
    raise QueryRejected("unknown-predicate-node", name)

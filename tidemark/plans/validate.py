"""Rules that a query must keep; they are checked before any plan is built.

Fixed values: the codes of the rules.
"""

from __future__ import annotations

from typing import Any

from ..errors import QueryRejected
from ..expr import All, And, Between, Compare, Group, Holds, Match, Member, Narrow, Not, Nothing, NullTest, Or, Predicate, Ref, Related
from ..model import TPH, Attribute, Model, ValueObject
from ..query import AGGREGATES, AggregateQuery, AsOf, Query, Range
from ..types import conforms


def covered(model: Model, names: tuple[str, ...]) -> set[str]:
    """The concrete entities that the named positions cover together."""
    return {c.qualified for n in names for c in model.concretes(n)}


def alternatives(model: Model, names: tuple[str, ...], within: set[str], outside: str) -> set[str]:
    """The concretes of a subtype selection; its members must be distinct, disjoint and inside the position."""
    if not names:
        return within
    full = [model.entity(n).qualified for n in names]
    if len(set(full)) != len(full):
        raise QueryRejected("subtype-selection-duplicate-alternative", ", ".join(names))
    out: set[str] = set()
    for n in full:
        own = covered(model, (n,))
        if out & own:
            raise QueryRejected("subtype-selection-overlapping-alternatives", n)
        if not own <= within:
            raise QueryRejected(outside, n)
        out |= own
    return out


def resolve(model: Model, position: str, active: set[str], ref: Ref) -> tuple[str, Attribute | ValueObject]:
    """(declaring concrete or position, first member) of an entity reference at an active position."""
    first = ref.path[0]
    home = {e.qualified for c in active for e in model.ancestry(c)} | {e.qualified for e in model.ancestry(position)}
    named = model.entity(ref.entity).qualified
    if named not in home and not covered(model, (named,)) & active:
        raise QueryRejected("attribute-outside-active-position", f"{ref.entity}.{first}")
    member = model.attribute(named, first) or model.value_object(named, first)
    if member is None:
        if model.relationship(named, first):
            raise QueryRejected("nested-path-first-segment-not-value-object", first)
        raise QueryRejected("unknown-member", f"{ref.entity}.{first}")
    # every active row must have the member
    for c in active:
        if model.attribute(c, first) is None and model.value_object(c, first) is None:
            raise QueryRejected("subtype-attribute-outside-narrow-scope", f"{ref.entity}.{first}")
    return named, member


def leaf(member: Attribute | ValueObject, path: tuple[str, ...]) -> tuple[Attribute | ValueObject, bool]:
    """(last member of a path, whether a list lies on the way)."""
    many = isinstance(member, ValueObject) and member.many
    for name in path:
        if not isinstance(member, ValueObject):
            raise QueryRejected("nested-path-first-segment-not-value-object", name)
        below = member.member(name)
        if below is None:
            raise QueryRejected("unknown-member", name)
        member = below
        many = many or (isinstance(member, ValueObject) and member.many)
    return member, many


class Checker:
    def __init__(self, model: Model) -> None:
        self.model = model

    def _literal(self, member: Attribute, value: Any, nested: bool) -> None:
        if not conforms(value, member.type):
            raise QueryRejected("nested-literal-type-mismatch" if nested else "literal-type-mismatch", f"{member.name}: {value!r}")

    def predicate(self, p: Predicate, position: str, active: set[str], shape: ValueObject | None = None) -> None:
        m = self.model

        def target(ref: Ref) -> Attribute | ValueObject:
            if ref.entity is None:
                if shape is None:
                    raise QueryRejected("element-reference-outside-scope", ".".join(ref.path))
                return leaf(shape, ref.path)[0]
            _, first = resolve(m, position, active, ref)
            return leaf(first, ref.path[1:])[0]

        def scalar(ref: Ref) -> Attribute:
            got = target(ref)
            if not isinstance(got, Attribute):
                raise QueryRejected("value-object-is-not-scalar", ".".join(ref.path))
            return got

        match p:
            case All() | Nothing():
                pass
            case Compare(_, ref, value):
                self._literal(scalar(ref), value, ref.nested)
            case Between(ref, low, high):
                a = scalar(ref)
                self._literal(a, low, ref.nested)
                self._literal(a, high, ref.nested)
                if type(low) is not type(high) or low > high:
                    raise QueryRejected("between-bounds-inverted", f"{low!r} {high!r}")
            case NullTest(ref, _):
                got = target(ref)
                if not got.nullable and not ref.nested:
                    raise QueryRejected("null-check-non-nullable-member", ".".join(ref.path))
            case Match(_, ref, value, _):
                a = scalar(ref)
                if a.type != "string":
                    raise QueryRejected("nested-string-predicate-non-string-member" if ref.nested else "string-predicate-non-string-member", a.name)
                if not isinstance(value, str):
                    self._literal(a, value, ref.nested)
            case Member(ref, values, _):
                if not values:
                    raise QueryRejected("membership-list-empty", ".".join(ref.path))
                for v in values:
                    self._literal(scalar(ref), v, ref.nested)
            case And(operands) | Or(operands):
                if len(operands) < 2:
                    raise QueryRejected("connective-needs-two-operands")
                for x in operands:
                    self.predicate(x, position, active, shape)
            case Not(operand) | Group(operand):
                self.predicate(operand, position, active, shape)
            case Narrow(subtypes, operand):
                if shape is not None or m.entity(position).inheritance is None:
                    raise QueryRejected("narrow-outside-position", ", ".join(subtypes))
                inner = alternatives(m, subtypes, covered(m, (position,)), "narrow-outside-position") & active
                if not inner:
                    raise QueryRejected("narrow-empty-effective-set", ", ".join(subtypes))
                self.predicate(operand, position, inner)
            case Related(entity, relationship, operand, _, narrow):
                if shape is not None:
                    raise QueryRejected("navigation-inside-element", relationship)
                owner = m.entity(entity).qualified
                r = m.relationship(owner, relationship)
                if r is None:
                    if m.value_object(owner, relationship):
                        raise QueryRejected("navigate-value-object-target", relationship)
                    raise QueryRejected("unknown-relationship", relationship)
                if not (covered(m, (owner,)) >= active or owner in {e.qualified for c in active for e in m.ancestry(c)}):
                    raise QueryRejected("attribute-outside-active-position", f"{entity}.{relationship}")
                inner = alternatives(m, narrow, covered(m, (r.target,)), "narrow-outside-relationship-target")
                self.predicate(operand, r.target, inner)
            case Holds(ref, operand, _):
                got = target(ref)
                if not isinstance(got, ValueObject):
                    raise QueryRejected("nested-path-first-segment-not-value-object", ".".join(ref.path))
                if operand is not None:
                    self.predicate(operand, position, active, got)
            case _:
                raise QueryRejected("unknown-predicate-node", type(p).__name__)

    def temporal(self, q: Query) -> None:
        axes = self.model.axes(q.target)
        for axis, chosen in q.temporal:
            if axis not in axes:
                raise QueryRejected("temporal-dimension-undeclared", axis)
            if isinstance(chosen, Range) and not chosen.start < chosen.end:
                raise QueryRejected("temporal-range-inverted", axis)
            if isinstance(chosen, AsOf) and chosen.at is None:
                raise QueryRejected("temporal-instant-missing", axis)
        if "valid" in axes and q.selection("valid") is None:
            raise QueryRejected("valid-time-selection-missing", q.target)

    def includes(self, q: Query, active: set[str]) -> None:
        m = self.model
        for path in q.includes:
            alternatives(m, path.guard, covered(m, (q.target,)), "narrow-outside-position")
            owner, inner = q.target, covered(m, path.guard) if path.guard else active
            for name, narrow in path.hops:
                r = m.relationship(owner, name)
                if r is None:
                    holders = [c for c in inner if m.relationship(c, name)]
                    if holders and len(holders) == len(inner):
                        owner = holders[0]
                        r = m.relationship(owner, name)
                    elif m.value_object(owner, name):
                        raise QueryRejected("deep-fetch-value-object-segment", name)
                    else:
                        raise QueryRejected("unknown-relationship", name)
                inner = alternatives(m, narrow, covered(m, (r.target,)), "narrow-outside-relationship-target")
                owner = r.target

    def query(self, q: Query) -> set[str]:
        """Check all of a query; the concrete entities of its result."""
        m = self.model
        within = covered(m, (q.target,))
        active = alternatives(m, q.narrow_to, within, "narrow-outside-position")
        self.predicate(q.predicate, q.target, active)
        self.temporal(q)
        for k in q.sort:
            if any(m.attribute(c, k.attribute) is None for c in active):
                raise QueryRejected("sort-key-outside-result-position", k.attribute)
        if q.top is not None and (not isinstance(q.top, int) or isinstance(q.top, bool) or q.top < 1):
            raise QueryRejected("limit-not-positive", str(q.top))
        self.includes(q, active)
        return active

    def aggregate(self, q: AggregateQuery) -> set[str]:
        active = self.query(q.source)
        m, names = self.model, [*q.group_by, *[a.alias for a in q.aggregates]]
        if not q.aggregates:
            raise QueryRejected("aggregates-empty")
        if len(set(names)) != len(names):
            raise QueryRejected("aggregate-duplicate-alias", ", ".join(names))
        for a in q.aggregates:
            if a.function not in AGGREGATES:
                raise QueryRejected("aggregate-unknown-function", a.function)
            if a.attribute is None and a.function != "count":
                raise QueryRejected("aggregate-attribute-missing", a.alias)
        for name in [*q.group_by, *[a.attribute for a in q.aggregates if a.attribute]]:
            if any(m.attribute(c, name) is None for c in active):
                raise QueryRejected("aggregate-illegal-reference", name)
        for name in [*[h.name for h in q.having], *[k.attribute for k in q.sort]]:
            if name not in names:
                raise QueryRejected("aggregate-illegal-reference", name)
        if q.top is not None and q.top < 1:
            raise QueryRejected("limit-not-positive", str(q.top))
        return active


def is_whole_family(model: Model, position: str, active: set[str]) -> bool:
    """Whether no tag test is needed, since all of a table's family is meant."""
    return model.strategy(position) != TPH or covered(model, (model.root(position).qualified,)) == active

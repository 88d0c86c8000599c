"""Predicate trees as Columns with SQL's three truth values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr import All, And, Between, Compare, Group, Holds, Match, Member, Narrow, Not, Nothing, NullTest, Or, Predicate, Ref, Related
from ..model import Attribute, ValueObject
from ..types import literal
from .documents import JsonDoc, NativeDoc

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "notEq": lambda a, b: a != b,
    "greaterThan": lambda a, b: a > b,
    "greaterThanEquals": lambda a, b: a >= b,
    "lessThan": lambda a, b: a < b,
    "lessThanEquals": lambda a, b: a <= b,
}


def test(p: Predicate, subject: Column, member: Attribute | ValueObject) -> Column:
    """A scalar node applied to its subject."""
    type_ = getattr(member, "type", "string")
    match p:
        case Compare(op, _, value):
            return _OPS[op](subject, literal(value, type_))
        case Between(_, low, high):
            return subject.between(literal(low, type_), literal(high, type_))
        case NullTest(_, negated):
            return subject.isNotNull() if negated else subject.isNull()
        case Member(_, values, negated):
            found = subject.isin(*[literal(v, type_) for v in values])
            return ~found if negated else found
        case Match(op, _, value, ignore_case):
            if ignore_case:
                subject, value = F.lower(subject), value.lower()
            if op in ("like", "notLike"):
                # a backslash escapes, as in the pattern language of SQL
                found = subject.like(value)
                return ~found if op == "notLike" else found
            return {"startsWith": subject.startswith, "endsWith": subject.endswith, "contains": subject.contains}[op](F.lit(value))
    raise TypeError(p)


class Lowering:
    """Turns predicates at one position into Columns.

    ``column`` gives an attribute's Column, ``document`` a value object's
    accessor, ``subtypes`` the test for some subtypes, ``related`` the test for
    a relationship; the compiler of queries provides them.
    """

    def __init__(
        self,
        member: Callable[[Ref], Attribute | ValueObject],
        column: Callable[[Attribute], Column],
        document: Callable[[ValueObject], JsonDoc | NativeDoc],
        subtypes: Callable[[tuple[str, ...]], Column],
        related: Callable[[Related], Column],
    ) -> None:
        self.member, self.column, self.document, self.subtypes, self.related = member, column, document, subtypes, related

    def lower(self, p: Predicate) -> Column:
        match p:
            case All():
                return F.lit(True)
            case Nothing():
                return F.lit(False)
            case And(operands):
                return reduce(lambda a, b: a & b, map(self.lower, operands))
            case Or(operands):
                return reduce(lambda a, b: a | b, map(self.lower, operands))
            case Not(operand):
                return ~self.lower(operand)
            case Group(operand):
                return self.lower(operand)
            case Narrow(subtypes, operand):
                return self.subtypes(subtypes) & self.lower(operand)
            case Related():
                return self.related(p)
            case Holds(ref, operand, negated):
                first = self.member(ref)
                return self._holds(self.document(first), first, ref.path[1:], operand, negated)
        first = self.member(p.ref)
        if isinstance(first, Attribute):
            return test(p, self.column(first), first)
        return self._nested(p, self.document(first), first, p.ref.path[1:])

    def _nested(self, p: Predicate, at: JsonDoc | NativeDoc, shape: ValueObject, path: tuple[str, ...]) -> Column:
        """A scalar node on a path: through a list it asks for any element, in negative forms too."""
        if shape.many:
            return at.any(lambda e: self._below(p, e, shape, path))
        return self._below(p, at, shape, path)

    def _below(self, p: Predicate, at: JsonDoc | NativeDoc, shape: ValueObject, path: tuple[str, ...]) -> Column:
        if not path:
            # the value object itself: only presence can be asked
            present = at.is_object()
            return present if p.negated else ~present
        member = shape.member(path[0])
        if isinstance(member, ValueObject):
            return self._nested(p, at.at(path[0]), member, path[1:])
        return test(p, at.at(path[0]).leaf(member.type), member)

    def _holds(self, at: JsonDoc | NativeDoc, shape: ValueObject, path: tuple[str, ...], operand: Predicate | None, negated: bool) -> Column:
        def present(at: JsonDoc | NativeDoc, shape: ValueObject, path: tuple[str, ...]) -> Column:
            if path:
                inner = shape.member(path[0])
                if shape.many:
                    return at.any(lambda e: present(e.at(path[0]), inner, path[1:]))
                return present(at.at(path[0]), inner, path[1:])
            if operand is None:
                return at.count() > 0 if shape.many else at.is_object()
            if shape.many:
                return at.any(lambda e: self._scoped(operand, e, shape))
            return F.coalesce(at.is_object() & self._scoped(operand, at, shape), F.lit(False))

        found = present(at, shape, path)
        return ~found if negated else found

    def _scoped(self, p: Predicate, at: JsonDoc | NativeDoc, shape: ValueObject) -> Column:
        """All of a compound on one element."""
        match p:
            case All():
                return F.lit(True)
            case Nothing():
                return F.lit(False)
            case And(operands):
                return reduce(lambda a, b: a & b, [self._scoped(x, at, shape) for x in operands])
            case Or(operands):
                return reduce(lambda a, b: a | b, [self._scoped(x, at, shape) for x in operands])
            case Not(operand):
                return ~self._scoped(operand, at, shape)
            case Group(operand):
                return self._scoped(operand, at, shape)
            case Holds(ref, operand, negated):
                return self._holds(at.at(ref.path[0]), shape.member(ref.path[0]), ref.path[1:], operand, negated)
        return self._below(p, at, shape, p.ref.path)

"""Query values: flat, immutable, and free of any plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from typing import Any

from .errors import QueryRejected
from .expr import All, And, EntityRef, PathRef, Predicate, from_dict, to_dict
from .model import SortKey


@dataclass(frozen=True)
class Latest:
    pass


@dataclass(frozen=True)
class AsOf:
    at: dt.datetime


@dataclass(frozen=True)
class Range:
    start: dt.datetime
    end: dt.datetime


@dataclass(frozen=True)
class History:
    pass


Selection = Latest | AsOf | Range | History

#: One hop of an include: relationship, subtypes it is narrowed to.
Hop = tuple[str, tuple[str, ...]]


@dataclass(frozen=True)
class Include:
    """A path of hops; ``guard`` keeps it to roots of these subtypes."""

    hops: tuple[Hop, ...]
    guard: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    target: str
    predicate: Predicate = All()
    narrow_to: tuple[str, ...] = ()
    temporal: tuple[tuple[str, Selection], ...] = ()
    sort: tuple[SortKey, ...] = ()
    top: int | None = None
    includes: tuple[Include, ...] = ()

    def where(self, *predicates: Predicate) -> Query:
        parts = [p for p in (self.predicate, *predicates) if not isinstance(p, All)]
        return replace(self, predicate=parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else All())

    def narrow(self, *subtypes: str | EntityRef) -> Query:
        if self.narrow_to:
            raise QueryRejected("narrow-given-twice")
        return replace(self, narrow_to=tuple(s if isinstance(s, str) else s._name for s in subtypes))

    def _select(self, axis: str, selection: Selection) -> Query:
        if any(a == axis for a, _ in self.temporal):
            raise QueryRejected("temporal-selection-given-twice", axis)
        return replace(self, temporal=(*self.temporal, (axis, selection)))

    def as_of(self, axis: str, at: dt.datetime | None = None) -> Query:
        """At an instant, or the latest where none is given."""
        return self._select(axis, Latest() if at is None else AsOf(at))

    def as_of_range(self, axis: str, start: dt.datetime, end: dt.datetime) -> Query:
        return self._select(axis, Range(start, end))

    def history(self, axis: str) -> Query:
        return self._select(axis, History())

    def order_by(self, *keys: SortKey) -> Query:
        return replace(self, sort=(*self.sort, *keys))

    def limit(self, n: int) -> Query:
        if self.top is not None:
            raise QueryRejected("limit-given-twice")
        return replace(self, top=n)

    def include(self, *paths: PathRef | Include) -> Query:
        made = tuple(p if isinstance(p, Include) else Include(p._hops) for p in paths)
        return replace(self, includes=(*self.includes, *made))

    def selection(self, axis: str) -> Selection | None:
        return dict(self.temporal).get(axis)

    def to_dict(self) -> dict[str, Any]:
        def chosen(s: Selection) -> dict[str, Any]:
            match s:
                case Latest():
                    return {"asOf": "latest"}
                case AsOf(at):
                    return {"asOf": at.isoformat()}
                case Range(start, end):
                    return {"asOfRange": [start.isoformat(), end.isoformat()]}
            return {"history": True}

        return {
            "target": self.target,
            "predicate": to_dict(self.predicate),
            "narrowTo": list(self.narrow_to),
            "temporal": {a: chosen(s) for a, s in self.temporal},
            "orderBy": [{"attribute": k.attribute, "descending": k.descending, "nullsFirst": k.nulls_first} for k in self.sort],
            "limit": self.top,
            "includes": [{"path": [[r, list(n)] for r, n in i.hops], "guard": list(i.guard)} for i in self.includes],
        }

    @staticmethod
    def from_dict(model, body: dict[str, Any]) -> Query:
        def chosen(b: dict[str, Any]) -> Selection:
            if "history" in b:
                return History()
            if "asOfRange" in b:
                return Range(*[dt.datetime.fromisoformat(x) for x in b["asOfRange"]])
            return Latest() if b["asOf"] == "latest" else AsOf(dt.datetime.fromisoformat(b["asOf"]))

        return Query(
            model.entity(body["target"]).qualified,
            from_dict(model, body.get("predicate", {"all": {}})),
            tuple(body.get("narrowTo", ())),
            tuple((a, chosen(b)) for a, b in body.get("temporal", {}).items()),
            tuple(SortKey(k["attribute"], k.get("descending", False), k.get("nullsFirst", False)) for k in body.get("orderBy", ())),
            body.get("limit"),
            tuple(Include(tuple((r, tuple(n)) for r, n in i["path"]), tuple(i.get("guard", ()))) for i in body.get("includes", ())),
        )


#: The closed set of aggregate functions.
AGGREGATES = ("count", "sum", "avg", "min", "max", "stdDevSample", "stdDevPop", "varianceSample", "variancePop")


@dataclass(frozen=True)
class Aggregate:
    function: str
    alias: str
    attribute: str | None = None


@dataclass(frozen=True)
class Having:
    """A condition on a group key or an alias: op of ``Compare``, or isNull / isNotNull."""

    name: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class AggregateQuery:
    """Groups of the rows that ``source`` selects; its order, limit and includes are not used."""

    source: Query
    aggregates: tuple[Aggregate, ...]
    group_by: tuple[str, ...] = ()
    having: tuple[Having, ...] = ()
    sort: tuple[SortKey, ...] = ()
    top: int | None = None

    def to_dict(self) -> dict[str, Any]:
        return {
            **self.source.to_dict(),
            "aggregates": [{"function": a.function, "alias": a.alias, "attribute": a.attribute} for a in self.aggregates],
            "groupBy": list(self.group_by),
            "having": [{"name": h.name, "op": h.op, "value": h.value} for h in self.having],
            "orderBy": [{"attribute": k.attribute, "descending": k.descending, "nullsFirst": k.nulls_first} for k in self.sort],
            "limit": self.top,
        }

    @staticmethod
    def from_dict(model, body: dict[str, Any]) -> AggregateQuery:
        source = Query.from_dict(model, {k: v for k, v in body.items() if k not in ("orderBy", "limit")})
        return AggregateQuery(
            source,
            tuple(Aggregate(a["function"], a["alias"], a.get("attribute")) for a in body["aggregates"]),
            tuple(body.get("groupBy", ())),
            tuple(Having(h["name"], h["op"], h.get("value")) for h in body.get("having", ())),
            tuple(SortKey(k["attribute"], k.get("descending", False), k.get("nullsFirst", False)) for k in body.get("orderBy", ())),
            body.get("limit"),
        )

"""Half-open intervals: selections on each axis as predicates, and the coordinates of results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AXIS_COLUMNS
from ..query import AsOf, History, Latest, Range, Selection
from ..types import INFINITY, instant


def is_open(end: Column) -> Column:
    """The upper bound of a current interval is the one sentinel, never null."""
    return end == instant(INFINITY)


def holds(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end > at)


def selected(start: Column, end: Column, chosen: Selection) -> Column | None:
    match chosen:
        case Latest():
            return is_open(end)
        case AsOf(at):
            return holds(start, end, instant(at))
        case Range(a, b):
            return (start < instant(b)) & (end > instant(a))
        case History():
            return None
    raise TypeError(chosen)


def effective(axes: tuple[str, ...], chosen: dict[str, Selection]) -> dict[str, Selection]:
    """The selection of each axis; a missing one is the latest."""
    return {a: chosen.get(a, Latest()) for a in axes}


def condition(col, axes: tuple[str, ...], chosen: dict[str, Selection]) -> Column | None:
    """All axes' predicates together, valid time first; ``col`` maps a column name to a Column."""
    out = None
    for axis, s in effective(axes, chosen).items():
        start, end = AXIS_COLUMNS[axis]
        p = selected(col(start), col(end), s)
        out = p if out is None else out if p is None else out & p
    return out


def propagated(axes: tuple[str, ...], chosen: dict[str, Selection]) -> dict[str, Selection]:
    """What a related entity gets: points go along by axis, anything else becomes the latest."""
    return {a: chosen[a] if isinstance(chosen.get(a), (Latest, AsOf)) else Latest() for a in axes}


def scanned(chosen: dict[str, Selection]) -> bool:
    """Whether a result has many milestones of one key."""
    return any(isinstance(s, (Range, History)) for s in chosen.values())


def edge(col, axes: tuple[str, ...]) -> Column:
    """A milestone's own coordinates: the start of each interval."""
    return F.struct(*[col(AXIS_COLUMNS[a][0]).alias(a) for a in axes])


def pin(axes: tuple[str, ...], chosen: dict[str, Selection]) -> Column:
    """The coordinates asked for; null stands for the latest."""

    def at(s: Selection) -> dt.datetime | None:
        return s.at if isinstance(s, AsOf) else None

    return F.struct(
        *[(instant(at(s)) if at(s) else F.lit(None).cast("timestamp_ntz")).alias(a) for a, s in effective(axes, chosen).items()]
    )

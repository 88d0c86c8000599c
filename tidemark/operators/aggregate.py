"""Grouped and ungrouped aggregation with conditions on groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..query import AggregateQuery, Having
from .predicates import _OPS

_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stdDevSample": F.stddev_samp,
    "stdDevPop": F.stddev_pop,
    "varianceSample": F.var_samp,
    "variancePop": F.var_pop,
}


def _condition(h: Having) -> Column:
    if h.op in ("isNull", "isNotNull"):
        return F.col(h.name).isNull() if h.op == "isNull" else F.col(h.name).isNotNull()
    return _OPS[h.op](F.col(h.name), F.lit(h.value))


def aggregated(df: DataFrame, q: AggregateQuery, column: Callable[[str], Column]) -> DataFrame:
    """Group keys by their names first, then aggregates in the order given.

    Without keys there is exactly one row, for no input as well.
    """
    made = [
        (F.count(F.lit(1)) if a.attribute is None else _FUNCTIONS[a.function](column(a.attribute))).alias(a.alias)
        for a in q.aggregates
    ]
    keys = [column(k).alias(k) for k in q.group_by]
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    for h in q.having:
        out = out.where(_condition(h))
    if q.sort:
        from ..plans.compile import sort_column

        out = out.orderBy(*[sort_column(F.col(k.attribute), k) for k in q.sort])
    return out.limit(q.top) if q.top is not None else out

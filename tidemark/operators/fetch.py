"""Deep fetch: related rows as nested columns, one join for each distinct hop.

A to-many view is an array, empty where nothing is related; a to-one view is a
struct or null; a view whose guard leaves a root out is null. A hop that leads
back to the one parent it came from needs no join, since its key is known. Where roots
are chosen by a predicate or limit, each level first keeps the rows whose parent
is wanted (a semi-join on the parents' keys, broadcast by Spark where they are
few), so only those are grouped. A parent with very many children has them in
one array: ``exploded`` gives flat rows, and ``flat`` without building arrays.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import AXIS_COLUMNS, Model, Relationship, SortKey
from ..plans.includes import Node, tree, view_key
from ..plans.validate import alternatives, covered
from ..query import History, Hop, Query
from . import temporal

if TYPE_CHECKING:
    from ..plans.compile import Compiler, Position

Nodes = dict[tuple[Hop, tuple[str, ...]], Node]


def _order(a: Column, b: Column, keys: list[SortKey]) -> Column:
    """A comparator of two structs by sort keys, nulls placed as each key says."""
    out = F.lit(0)
    for i in range(len(keys) - 1, -1, -1):
        x, y, k = a[f"k{i}"], b[f"k{i}"], keys[i]
        first = -1 if k.nulls_first else 1
        less = 1 if k.descending else -1
        out = (
            F.when(x.isNull() & y.isNull(), out)
            .when(x.isNull(), F.lit(first))
            .when(y.isNull(), F.lit(-first))
            .when(x < y, F.lit(less))
            .when(x > y, F.lit(-less))
            .otherwise(out)
        )
    return out


def _payload(at: Position, df: DataFrame, views: list[str], compiler: Compiler) -> Column:
    columns = [F.col(f"{at.alias}.`{c}`").alias(c) for c in compiler.columns(at)]
    return F.struct(*columns, *[df[f"`{v}`"].alias(v.split("\0")[-1]) for v in views])


def _attach(compiler: Compiler, at: Position, nodes: Nodes, came: tuple[str, Relationship] | None) -> tuple[DataFrame, list[str]]:
    """(rows with a column for each view, the columns' names)."""
    m, df, views = compiler.model, at.df, []
    for node in nodes.values():
        name, narrow = node.hop
        owner = next(c for c in [at.name, *sorted(at.active)] if m.relationship(c, name))
        r = m.relationship(owner, name)
        view = f"{at.alias}\0{view_key(node.hop)}"
        own = at.attribute(m.attribute(owner, r.join[0]))
        if came and not r.to_many and not narrow and not node.below and m.is_inverse(came[0], came[1].name, name):
            # the row was reached over the other side, so the key says it all
            df = df.withColumn(view, F.struct(own.alias(m.attribute(r.target, r.join[1]).column)))
            views.append(view)
            continue
        within = alternatives(m, narrow, covered(m, (r.target,)), "narrow-outside-relationship-target")
        scanned = temporal.scanned(at.chosen)
        shared = [a for a in m.axes(r.target) if a in m.axes(at.name)] if scanned else []
        chosen = temporal.propagated(m.axes(r.target), at.chosen)
        if scanned:
            chosen = {a: History() if a in shared else s for a, s in chosen.items()}
        child = compiler.position(r.target, within, chosen)
        key = child.attribute(m.attribute(r.target, r.join[1]))
        if at.restricted:
            # related rows of chosen parents only, before they are grouped and nested
            parents = at.df.select(own.alias(f"p_{child.alias}"))
            child.df = child.df.join(parents, key == F.col(f"p_{child.alias}"), "left_semi")
            child.restricted = True
        below, inner = _attach(compiler, child, node.below, (owner, next(x for x in m.relationships(owner) if x.name == name)))
        payload = _payload(child, below, inner, compiler)
        # milestones of a root are views of their own: children valid at the milestone's start
        tie = {f"e{i}": AXIS_COLUMNS[a] for i, a in enumerate(shared)}
        value = payload
        if r.to_many:
            pk = [SortKey(a.name) for a in m.primary_key(r.target)]
            keys = [*r.order_by, *[k for k in pk if k.attribute not in {x.attribute for x in r.order_by}]]
            first = sorted(child.active)[0]
            sort = [child.attribute(m.attribute(first, k.attribute)).alias(f"k{i}") for i, k in enumerate(keys)]
            value = F.struct(*sort, payload.alias("v"))
        if tie:
            points = at.df.select(own.alias("_key"), *[at.col(c[0]).alias(f"_{e}") for e, c in tie.items()]).distinct()
            rows = _at_starts(compiler, child, below, key, value, points, list(tie.values()))
        else:
            rows = below.select(key.alias("_key"), value.alias("_row"))
        if r.to_many:
            grouped = rows.groupBy("_key", *[f"_{n}" for n in tie]).agg(F.collect_list("_row").alias("_rows"))
            ordered = F.array_sort("_rows") if _plain(keys, m, first, rows.schema["_row"].dataType) else F.array_sort("_rows", _comparator(keys))
            side = grouped.select("_key", *[f"_{n}" for n in tie], F.transform(ordered, lambda x: x["v"]).alias(view))
        else:
            side = rows.withColumnRenamed("_row", view)
        side = side.alias(f"s_{child.alias}")
        same = [own == F.col(f"s_{child.alias}._key")]
        same += [at.col(c[0]) == F.col(f"s_{child.alias}._{e}") for e, c in tie.items()]
        df = df.join(side, reduce(lambda x, y: x & y, same), "left")
        value = F.col(f"s_{child.alias}.`{view}`")
        if r.to_many:
            empty = F.filter(F.array(F.lit(None).cast(side.schema[view].dataType.elementType)), lambda _: F.lit(False))
            value = F.coalesce(value, empty)
        if node.guard:
            value = F.when(at.is_one_of(covered(m, node.guard) & at.active), value)
        df = df.select(F.col(f"{at.alias}.*"), *[F.col(f"`{v}`") for v in views], value.alias(view)).alias(at.alias)
        views.append(view)
    return df, views


def _at_starts(
    compiler: Compiler, child: Position, below: DataFrame, key: Column, value: Column, points: DataFrame, axes: list[tuple[str, str]]
) -> DataFrame:
    """(_key, _e0.., _row): for each point of a key the children that hold there.

    On one axis the milestones of a child follow each other, so the one that
    holds at a point is the last that began: points and milestones are sorted
    together and each is read once. On two axes rectangles are compared.
    """
    m = compiler.model
    pk = [child.col(a.column).alias(f"_p{i}") for i, a in enumerate(m.primary_key(child.name))]
    pk += [child.col(c).alias(f"_p{len(pk)}") for c in child.types if c == "familyVariant"]
    names = [f"_p{i}" for i in range(len(pk))]
    if len(axes) > 1:
        inside = [temporal.holds(child.col(c[0]), child.col(c[1]), points[f"_e{i}"]) for i, c in enumerate(axes)]
        joined = below.join(points, reduce(lambda x, y: x & y, inside, key == points["_key"]))
        return joined.select(key.alias("_key"), *[points[f"_e{i}"] for i in range(len(axes))], value.alias("_row"))
    start, end = axes[0]
    chain = below.select(key.alias("_key"), *pk, child.col(start).alias("_e0"), F.struct(child.col(end).alias("end"), value.alias("row")).alias("_one"))
    asked = chain.select("_key", *names).distinct().join(points, "_key").select("_key", *names, "_e0", F.lit(None).cast(chain.schema["_one"].dataType).alias("_one"))
    # where both are at one instant the milestone comes first, since its start belongs to it
    order = Window.partitionBy("_key", *names).orderBy("_e0", F.col("_one").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = chain.unionByName(asked).withColumn("_last", F.last("_one", ignorenulls=True).over(order))
    found = every.where(F.col("_one").isNull() & (F.col("_last.end") > F.col("_e0")))
    return found.select("_key", "_e0", F.col("_last.row").alias("_row"))


def _plain(keys: list[SortKey], m: Model, name: str, row: T.StructType) -> bool:
    """Whether structs that begin with the sort keys are in order as they are compared by Spark itself."""

    def orderable(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(orderable(f.dataType) for f in t)
        return orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.VariantType, T.MapType))

    return orderable(row) and not any(k.descending or m.attribute(name, k.attribute).nullable for k in keys)


def _comparator(keys: list[SortKey]):
    return lambda a, b: _order(a, b, keys)


def fetched(compiler: Compiler, q: Query) -> DataFrame:
    """Root rows with one nested column for each included view; milestone reads carry their edge."""
    at = compiler.roots(q)
    df, views = _attach(compiler, at, tree(q.includes), None)
    axes = compiler.model.axes(q.target)
    extra = [temporal.edge(at.col, axes).alias("edge")] if temporal.scanned(at.chosen) else []
    own = [F.col(f"{at.alias}.`{c}`").alias(c) for c in compiler.columns(at)]
    df = df.select(*own, *extra, *[F.col(f"`{v}`").alias(v.split("\0")[-1]) for v in views])
    if q.sort:
        from ..plans.compile import sort_column

        # joins keep no order: the limited roots are put in order again
        first = sorted(at.active)[0]
        df = df.orderBy(*[sort_column(F.col(compiler.model.attribute(first, k.attribute).column), k) for k in q.sort])
    return df


def flat(compiler: Compiler, q: Query, relationship: str) -> DataFrame:
    """A row for each pair of a root and a row related to it, as structs ``parent`` and ``child``; nothing is grouped."""
    at, m = compiler.roots(q), compiler.model
    r = m.relationship(at.name, relationship)
    child = compiler.position(r.target, covered(m, (r.target,)), temporal.propagated(m.axes(r.target), at.chosen))
    own, key = at.attribute(m.attribute(at.name, r.join[0])), child.attribute(m.attribute(r.target, r.join[1]))
    return at.df.join(child.df, own == key).select(
        F.struct(*[at.col(c).alias(c) for c in compiler.columns(at)]).alias("parent"),
        F.struct(*[child.col(c).alias(c) for c in compiler.columns(child)]).alias("child"),
    )


def exploded(df: DataFrame, view: str, *keys: str) -> DataFrame:
    """Flat rows of a to-many view beside some root columns."""
    return df.select(*keys, F.explode(F.col(f"`{view}`")).alias("_row")).select(*keys, "_row.*")

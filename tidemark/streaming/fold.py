"""A stream of states folded into milestones.

Arrival order does not matter for the result: milestones of the keys that a
batch touches are derived again from all their states, late ones too, so a late
event is an ordinary correction of the chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.writes import IN, OUT, chained
from ..sources.store import Store


def refold(table: DataFrame, events: DataFrame, key: list[str], at: str) -> DataFrame:
    """The table of milestones with a batch of states put in; states of the same key and time replace the old."""
    states = [c for c in table.columns if c not in (IN, OUT)]
    touched = events.select(*key).distinct()
    old = table.join(touched, key, "left_semi").select(*states)
    new = events.select(*states).dropDuplicates([*key, at])
    kept = old.join(new.select(*key, at), [*key, at], "left_anti")
    again = chained(kept.unionByName(new), key, at).select(*table.columns)
    return table.join(touched, key, "left_anti").unionByName(again)


def fold_into(stream: DataFrame, store: Store, table: str, key: list[str], at: str, checkpoint: str) -> DataStreamWriter:
    """A writer that commits one version of the table for each batch, once even if a batch is run again."""

    def batch(events: DataFrame, number: int) -> None:
        done = store.manifest().get("#batch:" + table)
        if done is not None and int(done) >= number:
            return
        store.commit({table: refold(store.catalog().frame(table), events, key, at)}, notes={"#batch:" + table: str(number)})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def windowed(stream: DataFrame, at: str, keys: list[str], length: str, late: str, made: Callable[[], list]) -> DataFrame:
    """Tumbling windows of event time with a watermark: aggregates that stay bounded in state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(*made())

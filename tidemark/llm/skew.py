"""Joins that hold when one key has a third of all rows.

The side with one row a key knows how many rows each key meets. Keys above a
share of all rows are dealt over salts: their number is bounded by the share, so
the table of them is broadcast whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a thousandth of the rows is dealt; so at most a thousand keys are broadcast.
PARTS = 1000
LEAST = 1000


def salted_join(rows: DataFrame, one: DataFrame, key: str | list[str], count: str, spread: str, merge: bool = False, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has a row a key and ``count`` rows of the other side for it.

    ``one`` should be stored, since it is read more than once. Rows of a frequent key go
    to several tasks by the hash of ``spread``, its row of ``one`` to each.
    ``how`` is "inner" or "left".
    """
    keys = [key] if isinstance(key, str) else key
    total, top = one.agg(F.sum(count), F.max(count)).first()
    most = max(LEAST, (total or 0) // PARTS)
    small = one
    if merge:
        rows, small = rows.hint("merge"), one.hint("merge")
    if (top or 0) <= most:
        return rows.join(small, keys, how)
    hot = one.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_salts"))
    salts = F.sequence(F.lit(0), F.when(F.col(count) > most, F.ceil(F.col(count) / most).cast("int") - 1).otherwise(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    )
    return dealt.drop("_salts").join(small.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")

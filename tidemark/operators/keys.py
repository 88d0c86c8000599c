"""Primary keys for new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


SAMPLES = 20  # rows of the sample for each bucket


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds 1, 2, 3 ... in the given order without bringing all rows to one task.

    Rows are put into buckets by a sample of the order (quantiles), numbered in
    each, and moved by the count of the buckets before; a bucket count is one
    row. Cuts are values of the whole order and of a hash of the row, so that a
    frequent value of its first column is cut too. Rows that the order does not
    tell apart get numbers by that hash, and repeated rows in any order.
    """
    parts = min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(c) for c in order], F.xxhash64(*df.columns)]
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    sample = df.select(first.alias("s"), by[-1].alias("h")).orderBy(F.xxhash64("h"), "s").limit(parts * SAMPLES)
    kinds = [f.dataType for f in sample.schema["s"].dataType]
    sample = [r[0] for r in sample.select("s").orderBy("s").collect()]
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    cuts = [F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(c, kinds, strict=True))]) for n, c in enumerate(cuts) if not n or c != cuts[n - 1]]

    def below(a: int, b: int) -> Column:
        """How many cuts lie under the value, given that it is a to b of them."""
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(first <= cuts[mid], below(a, mid)).otherwise(below(mid + 1, b))

    bucket = below(0, len(cuts))
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    out = dealt.withColumn("_own", own).join(F.broadcast(before.drop("_size")), "_bucket")
    return out.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def allocate_max(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with keys after the table's largest, 1 where it is empty."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    made = numbered(new, order, "_n")
    return made.select((F.lit(top) + F.col("_n")).cast("long").alias(key), *[c for c in new.columns if c != key])


class Sequence:
    """A registry of key blocks: each claim takes whole batches, and what is unused stays a gap."""

    def __init__(self, batch: int, increment: int = 1, start: int = 1) -> None:
        if batch < 1 or increment < 1:
            raise ValueError("batch and increment must be positive")
        self.batch, self.increment, self.next = batch, increment, start

    def claim(self, n: int) -> int:
        """The first key for n rows."""
        first = self.next
        self.next += -(-n // self.batch) * self.batch * self.increment
        return first

    def allocate(self, new: DataFrame, key: str, order: list[str]) -> DataFrame:
        first = self.claim(new.count())
        made = numbered(new, order, "_n")
        value = F.lit(first) + (F.col("_n") - 1) * self.increment
        return made.select(value.cast("long").alias(key), *[c for c in new.columns if c != key])

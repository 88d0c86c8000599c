"""Deterministic datasets of any size, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import INFINITY, instant


def accounts(spark: SparkSession, n: int) -> DataFrame:
    """(id, owner, balance, version), ids from 1."""
    i = F.col("id")
    return spark.range(1, n + 1).select(
        i,
        F.concat(F.lit("owner-"), i).alias("owner"),
        (i * F.lit(100)).cast("decimal(18,2)").alias("balance"),
        F.lit(1).alias("version"),
    )


def orders_tree(spark: SparkSession, n: int, items: int, statuses: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders with ``items`` each, and ``statuses`` for each item."""
    orders = spark.range(1, n + 1).select("id", F.concat(F.lit("order-"), "id").alias("name"))
    lines = spark.range(n * items).select(
        (F.col("id") + 1).alias("id"),
        (F.floor(F.col("id") / items) + 1).alias("order_id"),
        F.concat(F.lit("sku-"), F.col("id") % items).alias("sku"),
        (F.col("id") % items + 1).cast("int").alias("quantity"),
    )
    marks = spark.range(n * items * statuses).select(
        (F.col("id") + 1).alias("id"),
        (F.floor(F.col("id") / (items * statuses)) + 1).alias("order_id"),
        (F.floor(F.col("id") / statuses) + 1).alias("order_item_id"),
        F.concat(F.lit("s-"), F.col("id") % statuses).alias("code"),
    )
    return orders, lines, marks


def milestones(spark: SparkSession, keys: int, each: int, days: int = 1, document: str | None = None) -> DataFrame:
    """(id, val, in_z, out_z): ``each`` chained milestones for each key, the last open.

    With ``document`` the value stands in a column of JSON of that name instead.
    """
    start = F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % {each} * {days} as int))")
    end = F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(cast((id % {each} + 1) * {days} as int))")
    last = F.col("id") % each == each - 1
    val = (F.col("id") % each * 10).cast("decimal(18,2)")
    if document:
        val = F.to_json(F.struct(val.cast("string").alias("val"), F.concat(F.lit("note-"), F.col("id") % each).alias("note")))
    return spark.range(keys * each).select(
        (F.floor(F.col("id") / each) + 1).alias("key"),
        val.alias(document or "val"),
        start.alias("in_z"),
        F.when(last, instant(INFINITY)).otherwise(end).alias("out_z"),
    ).withColumnRenamed("key", "id")

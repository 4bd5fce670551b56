"""Numbers and carried values in the order of a key's rows, for keys of any size.

A window over a key sorts all its rows in one task. Here the order is cut into blocks: each is scanned by itself,
and what precedes it comes from one row a block. Where the order is a number (a place in a file), the block is this
number's quotient and all is one lazy plan; else ``ranged_count`` cuts the order by range partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook.operators.alias_index import same
from haltbook.sources.scratch import scratch

SIZE = 4096


def _with_block(df: DataFrame, by: str, size: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(by) / size))


def _joined(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    on = [*keys, "__block"]
    return rows.alias("r").join(blocks.alias("b"), same("r", "b", on), "left").select("r.*", *(F.col(f"b.{v}") for v in values))


def number_rows(df: DataFrame, keys: Sequence[str], by: str, into: str, then: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``into``: the number (from 1) of each row in its key, ordered by the number ``by`` (nulls first), then ``then``."""
    blocked = _with_block(df, by, size)
    counts = blocked.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(by, *then))
    return _joined(blocked.withColumn("__own", own), offsets, keys, "__before").withColumn(into, F.col("__own") + F.col("__before")).drop("__block", "__own", "__before")


def carry_last(df: DataFrame, keys: Sequence[str], by: str, value: str, into: str, size: int = SIZE) -> DataFrame:
    """``into``: the last ``value`` that is not null up to each row of its key, ordered by the number ``by``."""
    blocked = _with_block(df, by, size)
    last = blocked.where(F.col(value).isNotNull()).groupBy(*keys, "__block").agg(F.max_by(value, by).alias("__last"))
    every = blocked.select(*keys, "__block").distinct()
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = _joined(every, last, keys, "__last").withColumn("__carried", F.last("__last", ignorenulls=True).over(w)).drop("__last")
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "__block").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(blocked.withColumn("__own", own), carried, keys, "__carried").withColumn(into, F.coalesce("__own", "__carried")).drop("__block", "__own", "__carried")


def ranged_count(df: DataFrame, keys: Sequence[str], order: str, flag: Column, into: str) -> DataFrame:
    """``into``: how many rows of the key that come before in ``order`` (any sortable column without ties) have the flag. The rows are
    written once, cut by range; of what is broadcast there are two rows a range at most."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranged")
    ranged = df.withColumn("__flag", F.coalesce(flag.cast("long"), F.lit(0)))
    ranged.repartitionByRange(*keys, order).withColumn("__block", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__flag").alias("__n"))
    w = Window.partitionBy(*keys)
    before = F.sum("__n").over(w.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumns({"__before": before, "__parts": F.count("*").over(w)}).where("__parts > 1 and __before > 0")
    own = F.sum("__flag").over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = _joined(rows.withColumn("__own", own), F.broadcast(offsets), keys, "__before")
    return joined.withColumn(into, F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("__block", "__own", "__before", "__flag")

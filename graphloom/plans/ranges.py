"""Orders over whole tables without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import stored


def running_before(df: DataFrame, order: list[str | Column], value: str | Column, to: str) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` over the rows before it in ``order``.

    Rows are dealt out by ranges of ``order``, as many as the session's shuffle partitions
    (adaptive execution joins small ones); sums of whole ranges come first, then sums inside
    a range. What is broadcast has one row a range.
    """
    value = F.col(value) if isinstance(value, str) else value
    dealt = stored(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_p").agg(F.sum("_v").alias("_s"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(F.broadcast(whole), "_p")
    return out.withColumn(to, (F.col("_in") + F.col("_from")).cast("long")).drop("_p", "_in", "_from", "_v")


def numbered(df: DataFrame, order: list[str | Column], to: str = "pos") -> DataFrame:
    """``df`` with ``to``: its place in ``order``, from 1."""
    return running_before(df, order, F.lit(1), "_before").withColumn(to, F.col("_before") + 1).drop("_before")

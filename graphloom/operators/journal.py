"""Changes since a position, with gaps and losses answered by null, and journal retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RECORDS = 16_384


def retained(journal: DataFrame, most: int = MAX_RECORDS) -> DataFrame:
    """The newest ``most`` records of each area's journal, by generation.

    What is broadcast has one row an area (``paths.area`` knows two).
    """
    newest = journal.groupBy("area").agg(F.max("generation").alias("_top"))
    return journal.join(F.broadcast(newest), "area").filter(F.col("generation") > F.col("_top") - most).drop("_top")


def changes_since(journal: DataFrame, since: int, current: int) -> DataFrame:
    """(known, path): the distinct paths changed after ``since`` up to ``current``, a row each.

    One row (false, null) for a position in the future, if a record between is missing, or if
    one lost its path; one row (true, null) if nothing changed.
    """
    after = journal.filter((F.col("generation") > since) & (F.col("generation") <= current))
    got = after.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").isNull()).alias("lost"), F.min("generation").alias("low")).first()
    whole = got["n"] == current - since and got["low"] in (None, since + 1) and not got["lost"]
    if since <= current and whole and got["n"]:
        return after.select(F.lit(True).alias("known"), "path").distinct()
    row = (since <= current and whole, None)
    return journal.sparkSession.createDataFrame([row], "known boolean, path string")


def gaps(journal: DataFrame) -> DataFrame:
    """(area, first, last, missing): how many generations an area's range lacks."""
    per = journal.groupBy("area").agg(F.min("generation").alias("first"), F.max("generation").alias("last"), F.count_distinct("generation").alias("_n"))
    return per.select("area", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("_n")).alias("missing"))


def reconcile(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed paths whose content did change: digests differ, or one is missing."""
    old, new = before.select("path", F.col("digest").alias("_o")), after.select("path", F.col("digest").alias("_n"))
    both = changed.select("path").distinct().join(old, "path", "left").join(new, "path", "left")
    return both.filter(~F.col("_o").eqNullSafe(F.col("_n"))).select("path")


def receipt_reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that fails, in order; null if all hold."""
    out = None
    for name, holds in checks.items():
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out if out is not None else F.lit(None).cast("string")

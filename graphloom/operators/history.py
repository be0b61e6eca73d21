"""Attempts and evidence: newest records, estimates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.ranges import numbered

SAMPLE = 20


def duration_estimates(attempts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(batch_id, estimate_ms): the median of a batch's newest passed runs that were no cache hits.

    Hits and failures are left out before the newest are taken. The mean of two middle
    values is cut to a whole number; durations under 0 count as 0.
    """
    ran = attempts.filter((F.col("status") == "passed") & (F.col("cache").isNull() | (F.col("cache") != "hit")))
    newest = Window.partitionBy("batch_id").orderBy(F.col("started_at_unix_ms").desc(), F.col("id").desc())
    kept = ran.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= sample)
    middle = F.median(F.greatest(F.col("duration_ms"), F.lit(0)))
    return kept.groupBy("batch_id").agg(F.floor(middle).cast("long").alias("estimate_ms"))


def newest(rows: DataFrame, time: str, limit: int) -> DataFrame:
    """The last ``limit`` rows by time, oldest first; ids break ties. A limit under 1 is an error."""
    if limit < 1:
        raise ValueError("the limit must be 1 or more")
    return rows.orderBy(F.col(time).desc(), F.col("id").desc()).limit(limit).orderBy(time, "id")


def subject_matches(subject: str) -> Column:
    """True for evidence of a subject, named with or without its capability."""
    full = F.concat(F.col("subject_id"), F.lit(":"), F.col("subject_capability"))
    return (F.col("subject_id") == subject) | F.coalesce(full == subject, F.lit(False))


def subject_display() -> Column:
    """``id:capability``, or the id alone."""
    return F.concat_ws(":", "subject_id", "subject_capability")


def run_counts(rows: DataFrame) -> DataFrame:
    """One row: passed and failed runs."""
    return rows.agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") != "passed").alias("failed"))


def longest_first(batches: DataFrame, estimates: DataFrame) -> DataFrame:
    """(batch_id, estimate_ms, pos): batches by estimate, longest first, ties by id; missing ones count as 0."""
    known = batches.select("batch_id").distinct().join(estimates, "batch_id", "left")
    known = known.withColumn("estimate_ms", F.coalesce("estimate_ms", F.lit(0).cast("long")))
    return numbered(known, [F.col("estimate_ms").desc(), F.col("batch_id")])


def adjacent_changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n_changes): neighbours in order with different values."""
    w = Window.partitionBy(key).orderBy(*order)
    before = rows.withColumn("_b", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    return before.groupBy(key).agg(F.count_if((F.col("_i") > 1) & ~F.col(value).eqNullSafe(F.col("_b"))).alias("n_changes"))


def is_invalid_attempt() -> Column:
    """Whether an attempt has no id or number, or ends before it starts."""
    return F.col("id").isNull() | (F.col("id") == "") | (F.col("attempt") < 1) | (F.col("finished_at_unix_ms") < F.col("started_at_unix_ms"))


def invalid_attempts(attempts: DataFrame) -> DataFrame:
    """Ids of attempts that fail an invariant."""
    return attempts.filter(is_invalid_attempt()).select("id")

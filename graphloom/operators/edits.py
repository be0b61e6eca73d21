"""Batches of edits to a table of targets: all of a batch takes effect, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(targets: DataFrame, edits: DataFrame) -> DataFrame:
    """(op, id) of creations of ids that exist, of updates and deletions of ids that don't, and of ids edited twice."""
    ids = targets.select("id").distinct()
    exist = edits.filter("op = 'create'").join(ids, "id", "left_semi").select("op", "id")
    lost = edits.filter("op <> 'create'").join(ids, "id", "left_anti").select("op", "id")
    twice = edits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("op").alias("op")).filter("n > 1").select("op", "id")
    return exist.unionAll(lost).unionAll(twice).distinct()


def apply(targets: DataFrame, edits: DataFrame, values: list[str]) -> DataFrame:
    """``targets`` (id and ``values``) after ``edits`` (op, id and ``values``); a null value of an update keeps the old one.

    Raises ValueError, and changes nothing, if the batch has a problem.
    """
    bad = problems(targets, edits).limit(5).collect()
    if bad:
        raise ValueError(f"the batch can't be applied: {[tuple(r) for r in bad]}")
    new = edits.filter("op = 'create'").select("id", *values)
    changed = edits.filter("op = 'update'").select("id", *[F.col(v).alias(f"_{v}") for v in values])
    kept = targets.join(edits.filter("op = 'delete'").select("id"), "id", "left_anti").join(changed, "id", "left")
    return kept.select("id", *[F.coalesce(f"_{v}", v).alias(v) for v in values]).unionByName(new)

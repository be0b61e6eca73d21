"""Content store: statistics, references, eviction by budget, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.ranges import running_before
from graphloom.sources.tables import stored


def stats(blobs: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: counts and bytes of blobs and actions (one row each)."""
    b = blobs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("what", F.lit("blobs"))
    a = actions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("what", F.lit("actions"))
    return b.unionByName(a)


def put_blobs(writes: DataFrame) -> DataFrame:
    """(digest, copies, first): one blob for each content; a content that is written again is not kept twice."""
    return writes.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("modified").alias("first"))


def refcounts(refs: DataFrame) -> DataFrame:
    """(digest, n): references to each blob; an action that names one twice counts twice."""
    return refs.groupBy(F.col("ref").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def orphans(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """Blobs that no action refers to; a blob without a digest is one."""
    return blobs.join(refs.select(F.col("ref").alias("digest")).distinct(), "digest", "left_anti")


def evict_orphans(blobs: DataFrame, refs: DataFrame, total: int, budget: int) -> DataFrame:
    """(digest, size): orphans to remove, oldest first, while more than the budget is left."""
    before = running_before(orphans(blobs, refs), ["modified", "digest"], "size", "_before")
    return before.filter(F.lit(total) - F.col("_before") > budget).select("digest", "size")


def evict_actions(blobs: DataFrame, actions: DataFrame, refs: DataFrame, total: int, budget: int) -> DataFrame:
    """(id, size, released): actions to remove, oldest first, and the bytes of blobs that go with each.

    ``total``: bytes left once all orphans are gone. A blob goes with the last action that
    refers to it.
    """
    order = ["modified", "id"]
    placed = actions.select(*order, "size")
    last = refs.select("id", "ref").distinct().join(placed.select(*order), "id")
    last = last.groupBy("ref").agg(F.max(F.struct(*order)).alias("_at"))
    released = last.join(blobs.select(F.col("digest").alias("ref"), F.col("size").alias("_b")), "ref")
    released = released.groupBy(F.col("_at.id").alias("id")).agg(F.sum("_b").alias("released"))
    weighed = placed.join(released, "id", "left").withColumn("released", F.coalesce("released", F.lit(0)))
    weighed = weighed.withColumn("_w", F.col("size") + F.col("released"))
    before = running_before(weighed, order, "_w", "_before")
    return before.filter(F.lit(total) - F.col("_before") > budget).select("id", "size", "released")


def gc_report(blobs: DataFrame, actions: DataFrame, refs: DataFrame, budget: int) -> DataFrame:
    """One row: bytes before and after, and what was removed. Nothing is, at or under the budget."""
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("s")).first()
    before = count(blobs, "size")["s"] + count(actions, "size")["s"]
    removed = {"blobs": 0, "actions": 0, "bytes": 0}
    if before > budget:
        all_orphans = count(orphans(blobs, refs), "size")
        gone = count(evict_orphans(blobs, refs, before, budget), "size")
        removed["blobs"], removed["bytes"] = gone["n"], gone["s"]
        if gone["n"] == all_orphans["n"] and before - gone["s"] > budget:
            out = stored(evict_actions(blobs, actions, refs, before - gone["s"], budget), "evicted")
            acts = count(out, "size")
            order = ["modified", "id"]
            last = refs.select("id", "ref").distinct().join(actions.select(*order), "id").groupBy("ref").agg(F.max(F.struct(*order)).alias("_at"))
            freed = last.join(out.select("id"), F.col("_at.id") == F.col("id"), "left_semi").join(blobs.select(F.col("digest").alias("ref")), "ref", "left_semi")
            removed["actions"] = acts["n"]
            removed["blobs"] += freed.count()
            removed["bytes"] += acts["s"] + count(out, "released")["s"]
    row = (before, before - removed["bytes"], removed["blobs"], removed["actions"])
    names = ("bytes_before", "bytes_after", "removed_blobs", "removed_actions")
    return blobs.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, row, strict=True)])


def put_latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: writes in order, the last one wins."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def forget(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of the given keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def tiered(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, tier): the local value of each key, else the remote one."""
    mine = local.select(key, F.col(value).alias("_l"))
    theirs = remote.select(key, F.col(value).alias("_r"))
    both = mine.join(theirs, key, "full")
    tier = F.when(F.col("_l").isNotNull(), "local").when(F.col("_r").isNotNull(), "remote")
    return both.select(key, F.coalesce("_l", "_r").alias(value), tier.alias("tier"))

"""Whether receipts of earlier runs still hold: one pass over receipts and the state of the world."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.journal import receipt_reason
from graphloom.plans.ranges import running_before

#: Why a receipt doesn't hold, in the order in which it is looked at.
REASONS = ("schema", "target", "sandbox", "filesystem tracker", "source change", "output change", "environment", "host path", "executable", "output")


@dataclass(frozen=True)
class Position:
    """Where a change tracker stands."""

    instance: str
    source_generation: int
    output_generation: int


@dataclass(frozen=True)
class World:
    """What receipts are held against.

    ``changes`` (generation, path): the tracker's journal of sources, a null path is a lost one;
    ``sources`` (path, digest) and ``outputs`` (path): what is there now; ``environment``
    (name, value); ``host_paths`` (path, fingerprint); ``executable``: its fingerprint.
    """

    position: Position
    changes: DataFrame
    sources: DataFrame
    outputs: DataFrame
    environment: DataFrame
    host_paths: DataFrame
    executable: str
    schema: str


def _known_from(changes: DataFrame, current: int) -> int:
    """The least generation since which the journal knows all changes up to ``current``."""
    seen = changes.filter(F.col("generation") <= current)
    generations = seen.select("generation").distinct()
    after_a_gap = generations.join(generations.select((F.col("generation") + 1).alias("generation")), "generation", "left_anti")
    bad = seen.filter("path IS NULL").agg(F.max("generation").alias("lost"))
    got = after_a_gap.agg(F.max("generation").alias("begin")).crossJoin(bad).first()  # one row each
    last = generations.agg(F.max("generation")).first()[0]
    if last != current:
        return current
    return max(x for x in (got["begin"] - 1, got["lost"]) if x is not None)


def _changed_since(receipts: DataFrame, last: DataFrame) -> DataFrame:
    """(generation, n): how many paths changed after each generation that a receipt was written at. ``last``: (path, generation)."""
    marks = receipts.select(F.col("source_generation").alias("generation"), F.lit(0).alias("_one")).distinct()
    both = marks.unionAll(last.select("generation", F.lit(1).alias("_one")))
    # a receipt's mark comes after the changes of its own generation, and before later ones
    placed = running_before(both, [F.col("generation"), F.col("_one").desc()], "_one", "_upto").filter("_one = 0")
    total = last.agg(F.count(F.lit(1)).alias("_all"))
    return placed.crossJoin(F.broadcast(total)).select("generation", (F.col("_all") - F.col("_upto")).alias("n"))  # one row is broadcast


def _differing(receipts: DataFrame, column: str, now: DataFrame, name: str, value: str, to: str) -> DataFrame:
    """(key, to): receipts of which an entry of the map ``column`` isn't as it is now."""
    held = receipts.select("key", F.explode(column).alias("_n", "_v"))
    there = now.select(F.col(name).alias("_n"), F.col(value).alias("_now"))
    bad = held.join(there, "_n", "left").filter(~F.col("_v").eqNullSafe(F.col("_now")))
    return bad.select("key").distinct().withColumn(to, F.lit(True))


def checked(wanted: DataFrame, receipts: DataFrame, world: World) -> DataFrame:
    """(key, cache, reason, and the receipt's position and source_digests): a hit, or why not.

    ``wanted`` (key, target, sandbox); ``receipts`` (key, schema, target, sandbox, instance,
    source_generation, output_generation, environment, host_paths, source_digests: maps;
    executable, outputs: array). A receipt that isn't there is a miss without a reason. Sources
    may have changed since if the receipt names every path that did, with its digest of now. A
    hit comes with the position of now; where that is another than the receipt's, its source
    digests are cleared.
    """
    now = world.position
    both = wanted.select("key", F.col("target").alias("_target"), F.col("sandbox").alias("_sandbox")).join(receipts, "key", "left")
    known_from = _known_from(world.changes, now.source_generation)
    last = world.changes.filter(F.col("path").isNotNull() & (F.col("generation") <= now.source_generation)).groupBy("path").agg(F.max("generation").alias("generation"))
    same = receipts.select("key", "source_generation", F.explode("source_digests").alias("path", "_digest"))
    same = same.join(last.select("path", F.col("generation").alias("_g")), "path").filter("_g > source_generation")
    same = same.join(world.sources.select("path", F.col("digest").alias("_digest")), ["path", "_digest"], "left_semi")
    same = same.groupBy("key").agg(F.count(F.lit(1)).alias("_same"))
    changed = _changed_since(receipts, last).select(F.col("generation").alias("source_generation"), F.col("n").alias("_changed"))
    lost = receipts.select("key", F.explode("outputs").alias("path")).join(world.outputs.select("path").distinct(), "path", "left_anti").select("key").distinct()
    for part in (same, _differing(receipts, "environment", world.environment, "name", "value", "_env"), _differing(receipts, "host_paths", world.host_paths, "path", "fingerprint", "_host")):
        both = both.join(part, "key", "left")
    both = both.join(changed, "source_generation", "left").join(lost.withColumn("_lost", F.lit(True)), "key", "left")
    since = F.col("source_generation")
    traced = since.between(known_from, now.source_generation) & (F.coalesce("_same", F.lit(0)) == F.coalesce("_changed", F.lit(0)))
    absent = lambda c: F.col(c).isNull()
    holds = (
        F.col("schema") == world.schema, F.col("target") == F.col("_target"), F.col("sandbox") == F.col("_sandbox"), F.col("instance") == now.instance,
        (since == now.source_generation) | traced, F.col("output_generation") == now.output_generation, absent("_env"), absent("_host"),
        F.col("executable") == world.executable, absent("_lost"),
    )
    there = F.col("schema").isNotNull()
    both = both.withColumn("reason", F.when(there, receipt_reason(dict(zip(REASONS, holds, strict=True)))))
    hit = there & F.col("reason").isNull()
    moved = hit & ~((since == now.source_generation) & (F.col("output_generation") == now.output_generation))

    def advanced(column: str, value) -> Column:
        return F.when(hit, F.lit(value)).otherwise(F.col(column)).alias(column)

    return both.select(
        "key", F.when(hit, "hit").otherwise("miss").alias("cache"), "reason", "instance", advanced("source_generation", now.source_generation),
        advanced("output_generation", now.output_generation), F.when(moved, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.col("source_digests")).alias("source_digests"),
    )

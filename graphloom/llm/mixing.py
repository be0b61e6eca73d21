"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get targets from their weights and sizes. The mix is a sequence of slots of
``block_words`` words each, whatever the corpus: slot k's golden-ratio point is mapped through
the cumulative targets to a source, slots are ranked within their source, and rank r takes
block r of the source's shuffled documents. A source that the schedule gives too many slots drops its last ones; one
short of slots gets them after the others; the last block is cut to the target. So every
source gives its target to the word, whatever the sizes.

Running sums are taken in two steps (sums of buckets, then inside a bucket), so no task gets
all rows of a source.

Defined cases: a null or empty text has size 0, is listed and never taken; null is a source
of its own and comes last; repeated rows each count and are told apart by ``_row``; an empty
table gives an empty result; a text of any length is placed by its number of words and may
span slots; ties of key, id and size go by ``_row``; extra columns are ignored. Sources (one
row each), not documents, are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, n_words, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a slot.
BLOCK_WORDS = 16_384
#: The golden ratio's fraction as a 32-bit multiplier: k * GOLDEN mod 2^32 fills the line evenly.
GOLDEN = 2_654_435_769
#: Rows of a bucket of a running sum, about, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 20_000, 16
#: Cells of the unit line in which points and sources meet.
CELLS = 4_096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, ...) by source; ``sizes`` has source and size.

    Targets share ``share`` of all words by weight; none passes ``most`` times its source's
    size. With sources in order of cap per weight, those before a place are capped and the
    rest share what is left, which is the fixed point of resharing. One row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    full_first = everything.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = full_first.rowsBetween(Window.unboundedPreceding, -1), full_first.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / F.sum("weight").over(onward))
    # The level of the first source whose cap stands above it holds for all after it.
    level = F.first(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.col("_level")), ignorenulls=True)
    per = per.withColumn("_water", level.over(full_first.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_water") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def source_key(source: Column) -> Column:
    """A text for each source, null too, to join on."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, doc_id, source, size, _key) of every row, written once: all later steps read it.

    ``_key``: 60 bits of a digest of the id (of the row's number where that is null), the order of a source's documents. ``_row`` is
    taken from ``docs`` if it has one.
    """
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), row.cast("string"))))
    rows = docs.select(
        row.alias("_row"),
        "doc_id",
        "source",
        n_words(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_key"),
    )
    return materialise(rows, "sized")


def running(df: DataFrame, bucket: Column, order: list[str], value: Column, to: str) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` over the rows of its source before it.

    Rows go by bucket, then by ``order``; a task holds one bucket of one source.
    """
    df = df.withColumn("_skey", source_key(F.col("source"))).withColumn("_bucket", bucket).withColumn("_value", value)
    totals = df.groupBy("_skey", "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_skey", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_skey", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_at", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    df = df.join(totals, ["_skey", "_bucket"])
    return df.withColumn(to, (F.col("_at") + F.col("_from")).cast("long")).drop("_skey", "_bucket", "_value", "_at", "_from")


def places(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with ``at``: words of the source's shuffled documents before each."""
    n = rows.count()
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_ROWS))
    bucket = (F.col("_key") / float((1 << 60) // buckets)).cast("long")
    return running(rows, bucket, ["_key", "doc_id", "size", "_row"], F.col("size"), "at")


def schedule(goals: DataFrame, block: int, slots: int) -> DataFrame:
    """(slot, source, rank): which block of which source fills each slot of the mix."""
    whole = Window.partitionBy(F.lit(0))
    by_source = whole.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(whole)
    goals = (
        goals.filter(F.round("target") >= 1)
        .withColumn("_to", upto)
        .withColumn("_low", F.coalesce(F.lag("_to").over(by_source), F.lit(0.0)))
        .withColumn("_high", F.when(F.lead("_to").over(by_source).isNull(), F.lit(1.0)).otherwise(F.col("_to")))
        .withColumn("_index", F.row_number().over(by_source).cast("long"))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_wanted", F.ceil(F.round("target") / block).cast("long"))
    )
    last_cell = F.least(F.floor(F.col("_high") * CELLS), F.lit(CELLS - 1))
    cells = goals.select("source", "_low", "_high", F.explode(F.sequence(F.floor(F.col("_low") * CELLS), last_cell)).alias("_cell"))
    point = F.pmod(F.col("id") * GOLDEN, F.lit(1 << 32)) / F.lit(float(1 << 32))
    points = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("_point"))
    points = points.withColumn("_cell", F.floor(F.col("_point") * CELLS))
    hits = points.join(cells, "_cell").filter("_point >= _low AND _point < _high").select("slot", "source")
    ranked = running(hits, F.floor(F.col("slot") / CELLS), ["slot"], F.lit(1), "rank").withColumn("_k", source_key(F.col("source")))
    goals = goals.withColumn("_k", source_key(F.col("source")))
    kept = ranked.join(goals.select("_k", "_wanted"), "_k").filter("rank < _wanted").select("slot", "source", "rank")
    had = kept.groupBy(source_key(F.col("source")).alias("_k")).agg(F.count(F.lit(1)).alias("_had"))
    short = goals.join(had, "_k", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).filter("_had < _wanted")
    extra = short.select("source", "_index", "_had", "_n", F.explode(F.sequence("_had", F.col("_wanted") - 1)).alias("rank"))
    extra = extra.select((slots + (F.col("rank") - F.col("_had")) * F.col("_n") + F.col("_index") - 1).alias("slot"), "source", "rank")
    return kept.unionByName(extra)


def mix(rows: DataFrame, goals: DataFrame, most: int = MOST, block_words: int | None = None) -> DataFrame:
    """(slot, _row, pass, from_word, to_word): the mix, in order of slot, pass, row.

    A row says that a slot takes words [from_word, to_word) of a document on its pass-th use.
    ``rows`` is what ``sized`` gave, ``goals`` what ``targets`` gave.
    """
    total = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    block = block_words or BLOCK_WORDS
    slots = int(-(-total // block))
    placed = places(rows.filter("size > 0")).withColumn("_k", source_key(F.col("source")))
    per = goals.select(source_key(F.col("source")).alias("_k"), "source_size", F.round("target").cast("long").alias("_goal"))
    placed = placed.join(per, "_k").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    placed = placed.withColumn("_lo", F.col("at") + F.col("pass") * F.col("source_size"))
    placed = placed.withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.col("_goal"))).filter("_lo < _hi")
    blocks = F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))
    pieces = placed.withColumn("rank", F.explode(blocks))
    plan = schedule(goals, block, slots).withColumn("_k", source_key(F.col("source"))).drop("source")
    start = F.greatest(F.col("_lo"), F.col("rank") * block) - F.col("_lo")
    end = F.least(F.col("_hi"), (F.col("rank") + 1) * block) - F.col("_lo")
    return pieces.join(plan, ["_k", "rank"]).select("slot", "_row", "pass", start.alias("from_word"), end.alias("to_word"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, its first and last slot, and in how many pieces."""
    rows = sized(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    goals = materialise(targets(rows), "targets")
    taken = mix(rows, goals).groupBy("_row").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_pieces")
    )
    per = goals.select(source_key(F.col("source")).alias("_k"), "source_size", "target")
    out = rows.withColumn("_k", source_key(F.col("source"))).join(per, "_k").join(taken, "_row", "left")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot", "last_slot", F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"),
    )


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS k FROM documents),
p AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn FROM p),
h AS (
  SELECT *, arg_min(lev, rn) FILTER (cap >= lev * w) OVER () AS water FROM l),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM h),
n AS (SELECT ceil(sum(target) / {BLOCK_WORDS})::BIGINT AS slots FROM t),
g0 AS (
  SELECT source, target, ceil(round(target) / {BLOCK_WORDS})::BIGINT AS wanted, row_number() OVER (ORDER BY source NULLS LAST) AS i, count(*) OVER () AS c,
    sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () AS upto FROM t WHERE round(target) >= 1),
g AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY i), 0.0) AS low, CASE WHEN i = c THEN 1.0 ELSE upto END AS high FROM g0),
k AS (SELECT range AS slot, (range * {GOLDEN} % 4294967296) / 4294967296.0::DOUBLE AS point FROM range((SELECT slots FROM n))),
q AS (
  SELECT slot, source, wanted, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM k JOIN g ON point >= low AND point < high),
kept AS (SELECT slot, source, rank FROM q WHERE rank < wanted),
had AS (SELECT g.*, (SELECT count(*) FROM kept WHERE kept.source IS NOT DISTINCT FROM g.source) AS had FROM g),
more AS (SELECT source, i, had, c, unnest(range(had, wanted)) AS rank FROM had WHERE had < wanted),
plan AS (SELECT * FROM kept UNION ALL SELECT (SELECT slots FROM n) + (rank - had) * c + i - 1, source, rank FROM more),
a AS (
  SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT r, source, pos + p * source_size AS lo, least(pos + p * source_size + size, goal) AS hi FROM a, (VALUES (0), (1)) AS v(p) WHERE size > 0),
pieces AS (SELECT *, unnest(range(lo // {BLOCK_WORDS}, (hi - 1) // {BLOCK_WORDS} + 1)) AS rank FROM u WHERE lo < hi),
s AS (
  SELECT r, sum(least(hi, (pieces.rank + 1) * {BLOCK_WORDS}) - greatest(lo, pieces.rank * {BLOCK_WORDS}))::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot,
    count(*) AS n_pieces FROM pieces JOIN plan ON pieces.source IS NOT DISTINCT FROM plan.source AND pieces.rank = plan.rank GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot, coalesce(n_pieces, 0) AS n_pieces FROM a LEFT JOIN s USING (r)
"""

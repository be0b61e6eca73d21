"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label are turned onto the principal axes of a bounded sample, so that the
leading dimensions hold most of a product. Two unit vectors of cosine t or more are at most
sqrt(2 - 2t) apart, in every axis too: rows are dealt to cells of that width along the
first axes, and only equal and adjacent cells meet, in tiles of two blocks. In a tile,
products are summed over leading dimensions first; what the others can still add is bounded
by the norms of the rest; rows and columns without a pair that can reach t are left out, and
the tile stops when none is left. What remains is decided by the cosine of the given
vectors in double precision.

The axes only set the order of work: the links are exact whatever the sample.

Defined cases: a vector that is null, of zero length, all zeros, or holds null or non-finite
components links with nothing and stands alone, as does one whose label is null; vectors of
different lengths don't link; equal vectors of a label form a class that is compared once;
repeated rows each count; ids (whole numbers or texts) may be null or repeat; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import tiles
from graphloom.llm.common import map_batches, materialise, read
from graphloom.llm.components import components, id_of, named

THRESHOLD = 0.93
BLOCK_ITEMS = 1_024
DIGEST_CHARS = 40
#: Vectors of the sample that gives the axes.
SAMPLE = 4_096
#: Leading dimensions after which a tile tests its bound.
STEPS = (8, 16, 32)
#: Slack for rounding in bounds; the last test has none.
SLACK = 1e-9


def axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length, the principal axes of a fixed sample, the longest first."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for n, some in by_length.items():
        x = np.array(some, dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[n] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaled first, so that no square overflows or vanishes."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return y / norm, norm


def _turned(unit: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    basis = turn.get(unit.shape[1])
    return unit if basis is None else unit @ basis


def with_cells(vectors: DataFrame, turn: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``vectors`` (node, copies, label, embedding) with c1 and c2: the cell on each of the first two axes."""
    width = math.sqrt(2 - 2 * threshold) + SLACK
    schema = T.StructType([*vectors.schema, T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType())])
    names = schema.names

    def place(batches):
        for b in batches:
            first, second = [], []
            for v in b.column("embedding").to_pylist():
                y = _turned(_unit(np.array([v], dtype=np.float64))[0], turn)[0]
                first.append(math.floor(y[0] / width))
                second.append(math.floor(y[1] / width) if len(y) > 1 else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=names)

    return map_batches(vectors, place, schema)


def near(x: np.ndarray, y: np.ndarray, turn: dict[int, np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows of ``x`` and ``y`` with cosine ``threshold`` or more."""
    (ux, _), (uy, _) = _unit(x), _unit(y)
    tx, ty = _turned(ux, turn), _turned(uy, turn)
    d = tx.shape[1]
    rest_x = np.sqrt(np.maximum(np.cumsum((tx**2)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_y = np.sqrt(np.maximum(np.cumsum((ty**2)[:, ::-1], axis=1)[:, ::-1], 0))
    rows, cols = np.arange(len(x)), np.arange(len(y))
    done, total = 0, np.zeros((len(x), len(y)))
    for step in [s for s in STEPS if s < d]:
        total += tx[rows, done:step] @ ty[cols, done:step].T
        done = step
        can = total + rest_x[rows, step][:, None] * rest_y[cols, step][None, :] >= threshold - SLACK
        keep_x, keep_y = can.any(axis=1), can.any(axis=0)
        if not keep_x.any():
            return np.zeros((len(x), len(y)), dtype=bool)
        rows, cols, total = rows[keep_x], cols[keep_y], total[np.ix_(keep_x, keep_y)]
    out = np.zeros((len(x), len(y)), dtype=bool)
    out[np.ix_(rows, cols)] = ux[rows] @ uy[cols].T >= threshold
    return out


def tile_links(turn: dict[int, np.ndarray], threshold: float):
    """For ``tiles.compare``: the links of a tile."""

    def links(table: pa.Table):
        names = table.column("node").to_pylist()
        weights = np.array(table.column("copies").to_pylist(), dtype=np.int64)
        x = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        side = np.array(table.column("side").to_pylist())
        if table.column("own")[0].as_py():
            a, b = np.nonzero(np.triu(near(x, x, turn, threshold), 1))
            return names, weights, a, b
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return names, weights, left[:0], left[:0]
        a, b = np.nonzero(near(x[left], x[right], turn, threshold))
        return names, weights, left[a], right[b]

    return links


def tiled(placed: DataFrame) -> DataFrame:
    """Every vector once for each tile it is in: (tile, own, side, node, copies, embedding)."""
    cell = ["label", "n", "c1", "c2"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS).cast("long").alias("blocks"))
    sizes = materialise(sizes, "cells")
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    around = sizes.withColumn("_d1", step).withColumn("_d2", step)
    around = around.select("label", "n", (F.col("c1") + F.col("_d1")).alias("c1"), (F.col("c2") + F.col("_d2")).alias("c2"), F.struct(F.col("c1").alias("c1"), F.col("c2").alias("c2"), "blocks").alias("_to"))
    met = sizes.join(around, cell).groupBy(*cell, "blocks").agg(F.collect_list("_to").alias("_tos"))
    rows = placed.join(met, cell).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("_to", F.explode("_tos"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to.blocks") - 1)))
    mine = F.struct(F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("_block").alias("k"))
    other = F.struct(F.col("_to.c1").alias("a"), F.col("_to.c2").alias("b"), F.col("_other").alias("k"))
    rows = rows.withColumn("_mine", mine).withColumn("_theirs", other)
    low, high = F.least("_mine", "_theirs"), F.greatest("_mine", "_theirs")
    return rows.select(
        F.to_json(F.struct("label", "n", low.alias("x"), high.alias("y"))).alias("tile"),
        (F.col("_mine") == F.col("_theirs")).alias("own"),
        (F.col("_mine") > F.col("_theirs")).cast("int").alias("side"),
        "node",
        "copies",
        "embedding",
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id, embedding, label)."""
    parts = F.col("embedding")
    usable = F.col("label").isNotNull() & parts.isNotNull() & (F.size(parts) > 0)
    finite = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = usable & F.coalesce(finite & F.exists(parts, lambda v: v != 0), F.lit(False))
    digest = F.sha1(F.to_json(F.struct("label", "embedding")))
    kind = vectors.schema["vec_id"].dataType
    rows = vectors.select("vec_id", "label", "embedding", F.when(usable, digest).alias("digest"))
    rows = materialise(rows, "vectors")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = classes.withColumn("node", named(F.col("rep"), kind, F.col("digest"))).withColumn("n", F.size("embedding"))
    classes = materialise(classes, "classes")
    turn = axes(classes)
    placed = with_cells(classes.select("node", "copies", "label", "n", "embedding"), turn, threshold)
    tile = tiled(materialise(placed, "placed")).repartition("tile").sortWithinPartitions("tile")
    found = materialise(map_batches(tile, tiles.compare(["tile"], tile_links(turn, threshold)), tiles.REPORT), "found")
    linked = found.groupBy("node").agg(F.sum("n_links").alias("_links"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    info = classes.select("node", "digest", "copies").join(linked, "node", "left").join(groups, "node", "left")
    # A component is named by its least node, whose name starts with its least id.
    least = id_of(F.coalesce("component", "node"), kind, DIGEST_CHARS)
    info = info.select("digest", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), least.alias("component_id"))
    out = rows.select("vec_id", "digest").join(info, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS m FROM embeddings UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.a),
c AS (SELECT a, min(m) AS m FROM r GROUP BY a)
SELECT d.vec_id, (SELECT count(*) FROM l WHERE l.a = d.vec_id)::BIGINT AS n_links, c.m AS component_id, d.vec_id = c.m AS kept
FROM embeddings d JOIN c ON c.a = d.vec_id
"""

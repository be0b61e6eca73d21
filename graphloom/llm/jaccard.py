"""N-gram Jaccard self-join by MinHash banding, checked on full n-gram sets.

1. Every text becomes a set of 64-bit hashes of its runs of five words, and a MinHash
   signature cut into bands; documents with equal sets form a class, and one stands for it.
2. Classes that share a band are candidates: each bucket of the shuffle on band hashes links
   its classes to its least one, and the connected groups of candidates are found.
3. Within a group every pair that shares a band is checked on the full sets, in tiles of two
   blocks of at most about BLOCK_ITEMS classes. A large group costs more tiles, not a larger
   task, and tiles report sums and roots, not pairs.

The result's classes are the connected groups of verified links.

Defined cases: a text of one to four words has one n-gram, all its words; a null text or one
without words links with nothing; ids (whole numbers or texts) may repeat or be null (a class
is named by its least id, null if it has none); a text of any length is hashed in parts; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import tiles
from graphloom.llm.common import map_batches, materialise, parts, read
from graphloom.llm.components import components, id_of, named

NGRAM = 5
THRESHOLD = 0.8
#: Chance that a pair at exactly the threshold shares a band, and most permutations to use.
RECALL, MOST_PERMUTATIONS = 0.999, 320
BLOCK_ITEMS = 1_024
#: Bytes of n-gram sets of a block, about.
BLOCK_BYTES = 16_000_000
#: Tasks that a large group's members are dealt to when they learn its number of blocks.
SPREAD = 32
DIGEST_CHARS = 32
#: Bytes of a text hashed at once.
PART_BYTES = 1 << 20


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_PERMUTATIONS) -> tuple[int, int]:
    """Most selective (bands, rows) with which a pair at ``threshold`` meets with chance ``recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.Generator(np.random.PCG64(20_240_817))
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    base = draw(1)[0] | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    up, down = np.full(PART_BYTES + 1, base), np.full(PART_BYTES + 1, inverse)
    up[0] = down[0] = 1
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return {
        "byte": draw(256), "up": np.cumprod(up), "down": np.cumprod(down), "space": space,
        "place": draw(NGRAM) | np.uint64(1), "times": draw(MOST_PERMUTATIONS) | np.uint64(1), "plus": draw(MOST_PERMUTATIONS),
        "band": draw(MOST_PERMUTATIONS) | np.uint64(1),
    }


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all of them."""
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word, by prefix sums of a polynomial over the bytes."""
    c, out, at = _constants(), [], 0
    while at < len(text):
        part = text[at : at + PART_BYTES]
        if at + len(part) < len(text) and not c["space"][part[-1]]:
            cut = max(part.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            if not cut:  # a word longer than a part: hashed by itself
                end = next((i for i in range(at, len(text)) if c["space"][text[i]]), len(text))
                out.append(np.array([xxhash.xxh64_intdigest(text[at:end])], dtype=np.uint64))
                at = end
                continue
            part = part[:cut]
        codes = np.frombuffer(part, dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], c["space"][codes], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(c["byte"][codes] * c["up"][: len(codes)], out=sums[1:])
        out.append(_mix((sums[end] - sums[start]) * c["down"][start]))
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of NGRAM words of a text."""
    w = word_hashes((text or "").encode())
    place = _constants()["place"]
    if not len(w):
        return w
    if len(w) < NGRAM:
        return _mix(np.array([(w * place[: len(w)]).sum() + np.uint64(len(w))], dtype=np.uint64))
    n = len(w) - NGRAM + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(NGRAM):
        total += w[i : i + n] * place[i]
    return np.unique(_mix(total))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band of the MinHash signature of a set, as signed 64-bit values."""
    c, k = _constants(), bands * rows
    times, plus = c["times"][:k, None], c["plus"][:k, None]
    least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 512):
        h = times * grams[None, i : i + 512]
        h += plus
        np.minimum(least, h.min(axis=1), out=least)
    signature = _mix(least.reshape(bands, rows))
    joined = (signature * c["band"][:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(joined).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_md5, digest, n_grams, bands): ``digest`` is that of the set; null without words."""
    schema = docs.select("doc_id").schema.add("text_md5", "string").add("digest", "string").add("n_grams", "long").add("bands", T.ArrayType(T.LongType()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            node, size, band = [], [], []
            for text in b.column("text").to_pylist():
                g = ngrams(text)
                node.append(xxhash.xxh3_128_hexdigest(g.tobytes()) if len(g) else None)
                size.append(len(g))
                band.append(band_hashes(g, bands, rows) if len(g) else None)
            cols = [b.column("doc_id"), b.column("text_md5"), pa.array(node, pa.string()), pa.array(size, pa.int64()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_batches(docs.select("doc_id", "text", F.md5("text").alias("text_md5")), sign, schema)


def _shared(table: pa.Table, n: int, own: bool, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of items of a tile that share a band: places (a, b), each pair once."""
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
    left = np.flatnonzero(side <= 0) if not own else np.arange(n)
    right = np.flatnonzero(side >= 1) if not own else left
    meet = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(bands.shape[1]):
        meet |= bands[left, k][:, None] == bands[right, k][None, :]
    if own:
        meet = np.triu(meet, 1)
    a, b = np.nonzero(meet)
    return left[a], right[b]


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets a[i] and b[i], for every i."""
    if len(a) <= 2_000:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
    # Many pairs of few sets: products of 0/1 columns for the n-grams that two sets or more hold.
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held[column] > 1
    owner, column = owner[keep], (np.cumsum(held > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, a_at = np.unique(a, return_inverse=True)
    right, b_at = np.unique(b, return_inverse=True)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4_096
    for low in range(0, int(held.size and (held > 1).sum()), width):
        i, j = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[owner[i:j], column[i:j] - low] = 1
        total += dense[left] @ dense[right].T
    return np.rint(total[a_at, b_at]).astype(np.int64)


def tile_links(threshold: float):
    """For ``tiles.compare``: the verified links of a tile."""
    ratio = Fraction(str(threshold))

    def links(table: pa.Table):
        names = table.column("node").to_pylist()
        weights = np.array(table.column("copies").to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(s, dtype="<u8") for s in table.column("grams").to_pylist()]
        side = np.array(table.column("side").to_pylist())
        a, b = _shared(table, len(names), bool(table.column("own")[0].as_py()), side)
        size = np.array([len(s) for s in sets])
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fits = low * ratio.denominator >= high * ratio.numerator
        a, b = a[fits], b[fits]
        if len(a):
            both = common_counts(sets, a, b)
            linked = both * ratio.denominator >= (size[a] + size[b] - both) * ratio.numerator
            a, b = a[linked], b[linked]
        return names, weights, a, b

    return links


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_md5, group, class_id, n_links, n_copies), one row for each row of ``docs``.

    ``docs`` has doc_id and text. ``group`` names the connected group (null without words),
    ``class_id`` is its least doc_id, ``n_links`` counts the other documents linked directly.
    """
    bands, rows = bands_and_rows(threshold, recall)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    signed = materialise(signatures(docs, bands, rows), "signatures")
    # Of each class: its least row, its size and its bands (equal in all its rows).
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(least).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
    )
    classes = materialise(classes.withColumn("node", named(F.col("rep.doc_id"), kind, F.col("digest"))), "classes")
    buckets = classes.select("node", F.explode("bands").alias("band"))
    met = buckets.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    candidates = components(buckets.join(met, "band").filter("node > v").select(F.col("node").alias("u"), "v").distinct())
    candidates = materialise(candidates, "candidates")

    sizes = candidates.join(classes.select("node", "n_grams"), "node").groupBy("component")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS), F.ceil(F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("long")
    # Groups of more than one block are told to their members in SPREAD parts each, so none is a hot key.
    large = sizes.agg(blocks.alias("n_blocks")).filter("n_blocks > 1")
    large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = candidates.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    chosen = dealt.join(large, ["component", "_salt"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    chosen = chosen.join(classes, "node")
    chosen = chosen.select("component", "n_blocks", "node", "copies", "bands", F.col("rep.doc_id").alias("_id"), F.col("rep.text_md5").alias("_md5"))
    # The id is part of the key, so the copies of a common text don't meet in one task.
    texts = docs.select(F.col("doc_id").alias("_doc"), "text", F.md5("text").alias("_text"))
    same = (F.col("_text") == F.col("_md5")) & F.col("_doc").eqNullSafe(F.col("_id"))
    chosen = texts.join(chosen.hint("shuffle_hash"), same).drop("_doc", "_text", "_id", "_md5").dropDuplicates(["node"])
    chosen = _with_sets(chosen)
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    tile = chosen.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    tile = tile.select(
        "component",
        F.least("_block", "_other").alias("i"),
        F.greatest("_block", "_other").alias("j"),
        (F.col("_block") == F.col("_other")).alias("own"),
        (F.col("_block") > F.col("_other")).cast("int").alias("side"),
        "node",
        "copies",
        "bands",
        "grams",
    )
    keys = ["component", "i", "j"]
    sets = tile.repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(map_batches(sets, tiles.compare(keys, tile_links(threshold)), tiles.REPORT), "found")

    linked = found.groupBy("node").agg(F.sum("n_links").alias("_links"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("component", "group")
    info = classes.select("node", "digest", "copies").join(linked, "node", "left").join(groups, "node", "left")
    # A group is named by its least node, whose name starts with its least id.
    info = info.withColumn("group", F.coalesce("group", "node")).withColumn("class_id", id_of(F.col("group"), kind, DIGEST_CHARS))
    info = info.withColumn("n_links", F.coalesce("_links", F.lit(0)) + F.col("copies") - 1)
    info = info.select("digest", "group", "class_id", "n_links", F.col("copies").alias("n_copies"))
    out = signed.select("doc_id", "text_md5", "digest").join(info, "digest", "left")
    return out.select(
        "doc_id", "text_md5", "group",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def _with_sets(rows: DataFrame) -> DataFrame:
    """``rows`` with texts replaced by ``grams``: their n-gram sets."""
    keep = [c for c in rows.columns if c != "text"]
    schema = rows.select(*keep).schema.add("grams", "binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            grams = pa.array([ngrams(t).astype("<u8").tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), grams], names=[*keep, "grams"])

    return map_batches(rows.select(*keep, "text"), sets, schema)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similar(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b, na.n = nb.n AND na.n = c AS equal FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c * 9 >= 4 * (na.n + nb.n)),
r AS (SELECT doc_id AS a, doc_id AS m FROM documents UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.a)
SELECT d.doc_id, (SELECT min(m) FROM r WHERE r.a = d.doc_id) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links,
  (SELECT count(*) + 1 FROM l WHERE l.a = d.doc_id AND equal)::BIGINT AS n_copies
FROM documents d
"""

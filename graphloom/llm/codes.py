"""Vector code compression: vectors as one byte a part, by codebooks fitted in whole numbers.

A component x becomes floor(256 x); vectors are cut into equal parts, and each part position
has a codebook of at most ``entries``. A part's nearest entry is screened by one float32
matrix product for a batch: distances less the part's own square come with an interval that
holds the true value whatever the order of the sums (n + 2 roundings, Cauchy-Schwarz). Every
entry whose interval meets the best one's is evaluated again in int64, and ties go to the
lower index, so the result is that of whole-number arithmetic.

Defined cases: rows whose vector is null, holds null or non-finite components, or hasn't the
length of the first kept row (by id) are dropped; so is every row if there is none to keep.
Null ids come last; repeated rows are rows of their own. Fewer kept rows than entries give
smaller codebooks. Lengths that ``parts`` doesn't divide are cut as evenly as can be. Whole
numbers beyond 2**62 are held there; sums of errors beyond a long are null. Labels may be
null (one group). Columns besides id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, materialise, read

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Sums of a label are told to its rows in so many parts, as one label may hold most rows.
SPREAD = 32
_HELD = 1 << 62
#: Up to here squares of differences of 512 components stay below 2**63.
_NARROW = 1 << 26
_UNIT = 2.0**-24


def kept(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows whose vector is whole."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(fine, F.lit(False)))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE x) of a batch of vectors, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -_HELD, _HELD).astype(np.int64).reshape(-1, width)


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def _exact(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, a pair each; Python's whole numbers where int64 is too narrow."""
    if not _fits(rows, entries):
        rows, entries = rows.astype(object), entries.astype(object)
    return ((rows - entries) ** 2).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), np.int64)


def _fits(*numbers: np.ndarray) -> bool:
    return all(n.size == 0 or (n.shape[1] <= 512 and -_NARROW <= n.min() and n.max() <= _NARROW) for n in numbers)


def candidates(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be a row's nearest, by float32 products and their rounding-error intervals."""
    if not _fits(rows, book):
        return np.ones((len(rows), len(book)), bool)
    products = (rows.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    squares = (book.astype(np.float64) ** 2).sum(axis=1)
    n = rows.shape[1] + 2
    lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
    off = 2 * (n * _UNIT / (1 - n * _UNIT)) * lengths * (1 + 1e-9) + 1e-12 * (squares[None, :] + lengths)
    near = squares[None, :] - 2 * products
    return near - off <= (near + off).min(axis=1, keepdims=True)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index."""
    may = candidates(rows, book)
    index = may.argmax(axis=1)
    open_rows = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_rows):
        at, entry = np.nonzero(may[open_rows])  # by row, then by entry
        distance = _exact(rows[open_rows[at]], book[entry])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == least[at])
        _, of_row = np.unique(at[hits], return_index=True)
        index[open_rows] = entry[hits[of_row]]
    return index, _exact(rows, book[index])


def _book_array(book: list[list[int]], width: int) -> np.ndarray:
    return np.array(book, dtype=np.int64).reshape(len(book), width)


def _sums(df: DataFrame, vector_col: str, width: int, books: list[list[list[int]]]) -> DataFrame:
    """(part, entry, n, sums): for each task the number and the sums of the parts nearest to an entry."""
    cuts = bounds(width, len(books))
    number = T.DecimalType(38, 0)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(number))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_book_array(b, hi - lo) for b, (lo, hi) in zip(books, cuts, strict=True)]
        counts = [np.zeros(len(b), np.int64) for b in arrays]
        totals = [np.zeros(b.shape, object) for b in arrays]
        for batch in batches:
            rows = _whole(batch.column(0), width)
            for k, (lo, hi) in enumerate(cuts):
                part = rows[:, lo:hi]
                index, _ = nearest(part, arrays[k])
                counts[k] += np.bincount(index, minlength=len(arrays[k]))
                batch_sums = np.zeros(arrays[k].shape, np.int64 if _fits(part) else object)
                np.add.at(batch_sums, index, part.astype(batch_sums.dtype))
                totals[k] += batch_sums.astype(object)
        out = [(k, e, int(counts[k][e]), [Decimal(int(x)) for x in totals[k][e]]) for k in range(len(cuts)) for e in np.flatnonzero(counts[k]).tolist()]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "sums"])

    return map_batches(df.select(vector_col), run, schema)


def codebooks(df: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """For each part the entries' components after ``rounds`` rounds; what the driver holds is entries x vector length numbers.

    ``df`` holds kept rows. Without rows there are no entries.
    """
    first = kept(df, id_col, vector_col).orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(1).collect()
    if not first:
        return [[] for _ in range(parts)]
    width = len(first[0][0])
    df = df.filter(F.size(vector_col) == width)
    rows = df.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).toArrow().column(0).combine_chunks()
    start = _whole(rows, width) if width else np.zeros((len(rows), 0), np.int64)
    books = [start[:, lo:hi].tolist() for lo, hi in bounds(width, parts)]
    for _ in range(rounds):
        each = _sums(df, vector_col, width, books).select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            books[r["part"]][r["entry"]][r["place"]] = int(r["x"]) // r["n"]
    return books


def coded(df: DataFrame, keep: list[str], vector_col: str, books: list[list[list[int]]]) -> DataFrame:
    """``keep`` with code (binary, a byte a part) and error (long) of each row."""
    width = sum(len(b[0]) for b in books)
    cuts = bounds(width, len(books))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_book_array(b, hi - lo) for b, (lo, hi) in zip(books, cuts, strict=True)]
        for batch in batches:
            rows = _whole(batch.column(vector_col), width)
            found = [nearest(rows[:, lo:hi], book) for (lo, hi), book in zip(cuts, arrays, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            errors = [e if e < 1 << 63 else None for e in sum(d.astype(object) for _, d in found).tolist()]
            columns = [*(batch.column(c) for c in keep), pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "code", "error"])

    return map_batches(df.select(*keep, vector_col), run, schema)


def digest_text(books: list[list[list[int]]]) -> str:
    """All components of all entries by part, entry and place."""
    return ",".join(str(x) for book in books for entry in book for x in entry)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """((id, label, code binary, error), codebooks): a code is a byte for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code's byte holds 256 entries at most")
    whole = kept(df.select(id_col, vector_col, label_col), id_col, vector_col)
    books = codebooks(whole, id_col, vector_col, parts, entries, rounds)
    if not books[0]:
        empty = F.lit(None)
        return whole.limit(0).select(id_col, label_col, empty.cast("binary").alias("code"), empty.cast("long").alias("error")), books
    width = sum(len(b[0]) for b in books)
    return coded(whole.filter(F.size(vector_col) == width), [id_col, label_col], vector_col, books), books


def decompressed(df: DataFrame, books: list[list[list[int]]], code_col: str = "code", to: str = "restored") -> DataFrame:
    """``df`` with ``to``: the vector that a code stands for, entry by entry, in the vectors' own scale. A null code gives null."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]).cast("array<double>") for entry in book]) for book in books])
    entry = lambda k: F.element_at(F.element_at(table, k + 1), F.conv(F.hex(F.substring(code_col, k + 1, 1)), 16, 10).cast("int") + 1)
    vector = F.flatten(F.array(*[entry(k) for k in range(len(books))]))
    return df.withColumn(to, F.when(F.col(code_col).isNotNull(), vector))


def with_label_errors(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``df`` with label_error: the errors of rows of an equal label (nulls are equal) summed; null beyond a long."""
    dealt = df.withColumn("_s", F.pmod(F.xxhash64(*[c for c in df.columns if c != label_col]), F.lit(SPREAD)))
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    unknown = F.count_if(F.col("error").isNull())
    longest = F.lit((1 << 63) - 1)
    sums = df.groupBy(F.col(label_col).alias("_label")).agg(F.when(unknown == 0, total).alias("_e"))
    sums = sums.select("_label", F.when(F.col("_e") <= longest, F.col("_e")).cast("long").alias("label_error"))
    sums = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    both = dealt.join(sums, (dealt["_s"] == sums["_t"]) & dealt[label_col].eqNullSafe(sums["_label"]))
    return both.drop("_s", "_t", "_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, error of its label and digest of all codebooks for every kept vector."""
    rows, books = compress(read(spark, sf_dir, "embeddings"))
    rows = materialise(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    out = with_label_errors(rows).withColumn("codebooks_sha256", F.sha2(F.lit(digest_text(books)).cast("binary"), 256))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(name: str, books: str) -> str:
    """SQL of the nearest entry (m = distance * 64 + index) of every part in ``books``."""
    return f"""{name} AS (
  SELECT p.vec_id, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) * 64 + b.entry) AS m
  FROM parts p JOIN {books} b ON p.part = b.part GROUP BY p.vec_id, p.part, p.x
)"""


def _moved(name: str, assigned: str, books: str) -> str:
    """SQL of the codebooks after the entries are moved to the floor of their parts' means."""
    return f"""{name}_places AS (
  SELECT part, (m % 64)::BIGINT AS entry, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM {assigned}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
), {name}_means AS (
  SELECT part, entry, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM {name}_places GROUP BY ALL
), {name} AS (
  SELECT b.part, b.entry, coalesce(a.x, b.x) AS x FROM {books} b LEFT JOIN {name}_means a ON a.part = b.part AND a.entry = b.entry
)"""


OP11_SQL = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM kept, unnest(range(16)) AS u(part)
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), books0 AS (SELECT part, entry, x FROM parts JOIN seeds USING (vec_id)),
{_assigned("near1", "books0")}, {_moved("books1", "near1", "books0")},
{_assigned("near2", "books1")}, {_moved("books2", "near2", "books1")},
{_assigned("near3", "books2")}, coded AS (
  SELECT vec_id, string_agg(lpad(to_hex((m % 64)::BIGINT), 2, '0'), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM near3 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(x[i]::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM books2, unnest(range(1, len(x) + 1)) AS u(i)
)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest"""

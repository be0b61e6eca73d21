"""Byte-level BPE: encoding of whole texts by overlapping chunks, and decoding.

Texts of at most ``chunk_chars`` characters are encoded where they are read. Longer texts
are cut into chunks that overlap; the chunks are pre-tokenised in parallel, each from its
own start. A pre-token boundary depends only on the text after it, so once a chunk and the
one before share a boundary they agree from there on: texts are cut at such shared
boundaries and the pieces encoded in parallel. A text without one in some overlap (a
pre-token longer than the overlap, say) is put together again and encoded whole.

Defined cases: null text counts as empty (no tokens); repeated rows each give a row; ids
may be null or repeat; other input columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, parts, read

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: A boundary closer to a chunk's end may be one only because the chunk ends there:
#: the pattern's longest literal has 3 characters and it looks 1 ahead.
MARGIN = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _byte_table(path: str) -> list[bytes]:
    table = [b""] * (max(_ranks(path).values()) + 1)
    for token, rank in _ranks(path).items():
        table[rank] = token
    return table


def _encode(path: str, text: str | None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    import numpy as np

    return np.array(_encoding(path).encode_ordinary(text or ""), dtype="<u4").tobytes()


def encode_column(df: DataFrame, keep: list[str], text_col: str, path: str) -> DataFrame:
    """``keep`` columns and ``ids`` (binary) of each row's text, in place."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids = pa.array([_encode(path, t) for t in b.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    return map_batches(df.select(*keep, text_col), encode, schema)


def _chunks(df: DataFrame, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """(id, _row, k, last, piece): piece k starts at k * chunk and runs ``overlap`` into the next."""
    id_type = df.schema[id_col]
    schema = T.StructType(
        [id_type, T.StructField("_row", T.LongType()), T.StructField("k", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("piece", T.StringType())]
    )
    arrow_names = [id_col, "_row", "k", "last", "piece"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(text_col).to_pylist()):
                n = -(-len(text) // chunk)
                rows = [pa.array(b.column(c).slice(i, 1).to_pylist() * n, b.column(c).type) for c in (id_col, "_row")]
                rows += [
                    pa.array(range(n), pa.int64()),
                    pa.array([k == n - 1 for k in range(n)]),
                    pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=arrow_names)

    return map_batches(df, cut, schema)


def boundaries(piece: str, start: int, chunk: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Places in the whole text where ``piece`` may be joined to the chunk before and to the next.

    Places are pre-token boundaries between a visible ASCII character and a space or line
    end, in the overlap at the piece's head and in that at its tail.
    """
    import public_tokenizers
    import regex

    pattern = _compiled(regex, public_tokenizers.PATTERN)
    end = len(piece) - (0 if last else MARGIN)
    head, tail = [], []
    for m in pattern.finditer(piece):
        e = m.end()
        if e >= len(piece) or e > end or not (overlap > e or e >= chunk):
            continue
        if "!" <= piece[e - 1] <= "~" and piece[e] in " \n":
            if e < overlap:
                head.append(start + e)
            if e >= chunk:
                tail.append(start + e)
    return head, tail


@lru_cache(maxsize=4)
def _compiled(regex, pattern: str):
    return regex.compile(pattern)


def _pretokenise(pieces: DataFrame, chunk: int, overlap: int) -> DataFrame:
    places = T.ArrayType(T.LongType())
    schema = T.StructType([*pieces.schema, T.StructField("head", places), T.StructField("tail", places)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = zip(b.column("piece").to_pylist(), b.column("k").to_pylist(), b.column("last").to_pylist(), strict=True)
            found = [boundaries(piece, k * chunk, chunk, overlap, last) for piece, k, last in rows]
            kind = pa.list_(pa.int64())
            more = [pa.array([f[i] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "head", "tail"])

    return map_batches(pieces, scan, schema)


def _join_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, ids) from (id, parts: array of (k, ids) in order)."""
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([b"".join(p["ids"] for p in parts) for parts in b.column("parts").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(id_col), ids], names=[id_col, "ids"])

    return map_batches(df.select(id_col, "parts"), join, schema)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id, ids binary, n_tokens long), one row for each row of ``docs``.

    ``ids`` holds little-endian unsigned 32-bit integers. ``docs`` should be a table read
    from files: rows of long texts are told apart by their place in it.
    """
    if overlap_chars > chunk_chars:
        raise ValueError("the overlap can't be longer than a chunk")
    path = vocabulary or default_vocabulary()
    docs = docs.select(id_col, text_col)
    long = F.length(text_col) > chunk_chars
    short_ids = encode_column(docs.filter(~F.coalesce(long, F.lit(False))), [id_col], text_col, path)

    pieces = _chunks(docs.filter(long).withColumn("_row", F.monotonically_increasing_id()), id_col, text_col, chunk_chars, overlap_chars)
    pieces = _pretokenise(pieces.repartition("_row", "k"), chunk_chars, overlap_chars)
    row = Window.partitionBy("_row").orderBy("k")
    start = F.col("k") * chunk_chars
    pieces = (
        pieces.withColumn("begin", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(row)))))
        .withColumn("end", F.when(F.col("last"), start + F.length("piece")).otherwise(F.array_min(F.array_intersect("tail", F.lead("head").over(row)))))
        .withColumn("broken", F.max(F.col("begin").isNull() | F.col("end").isNull()).over(Window.partitionBy("_row")))
    )
    joined = pieces.filter(~F.col("broken")).withColumn(
        "_text", F.substring("piece", (F.col("begin") - start + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    )
    parts = encode_column(joined, [id_col, "_row", "k"], "_text", path)
    parts = parts.groupBy(id_col, "_row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = (
        pieces.filter("broken")
        .withColumn("piece", F.when(F.col("last"), F.col("piece")).otherwise(F.substring("piece", 1, chunk_chars)))
        .groupBy(id_col, "_row")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("_text"))
    )
    ids = short_ids.unionAll(_join_ids(parts, id_col)).unionAll(encode_column(whole, [id_col], "_text", path))
    return ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, to: str = "decoded") -> DataFrame:
    """``df`` with its ids replaced by ``to``: the bytes that the ids stand for, one after another.

    Null ids give null. An id outside the vocabulary is an error.
    """
    import numpy as np

    path = vocabulary or default_vocabulary()
    keep = [c for c in df.columns if c not in (ids_col, to)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.BinaryType())])

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _byte_table(path).__getitem__
        for b in parts(batches):
            ids = b.column(ids_col).to_pylist()
            out = [None if x is None else b"".join(map(of, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, to])

    return map_batches(df.select(*keep, ids_col), decode_batches, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    ids = encode(read(spark, sf_dir, "documents")).withColumn("ids_sha256", F.sha2("ids", 256))
    out = decode(ids).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

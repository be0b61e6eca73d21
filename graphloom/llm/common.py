"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.sources.tables import map_batches
from graphloom.sources.tables import stored as materialise
from graphloom.sources.tables import table as read

__all__ = ["SPACES", "crc_remainder", "let", "map_batches", "materialise", "n_words", "parts", "read", "words"]

#: A word is a longest run of characters outside ``SPACES``.
SPACES = "\\x20\\x09-\\x0D"

#: Rows of a batch that a worker holds as Python objects at once.
ROWS = 500


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, in order."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+")
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` as a long; null text has none.

    ``split`` yields one empty string at each end that starts or ends with white space.
    """
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, f"[{SPACES}]+"))
    edges = t.rlike(f"\\A[{SPACES}]").cast("int") + t.rlike(f"[{SPACES}]\\z").cast("int")
    blank = ~t.rlike(f"[^{SPACES}]")
    return F.when(blank, F.lit(0)).otherwise(parts - edges).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus

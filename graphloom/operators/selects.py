"""Values that depend on a configuration: ``{"select": {token: value, ..}}`` at any depth of an attribute."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources.tables import map_batches


def resolve(value: object, tokens: list[str]) -> object:
    """``value`` with every select replaced by its branch of the first token that has one. LookupError if none has."""
    if isinstance(value, dict):
        if list(value) == ["select"] and isinstance(value["select"], dict):
            for t in tokens:
                if t in value["select"]:
                    return resolve(value["select"][t], tokens)
            raise LookupError("no branch matches")
        return {k: resolve(v, tokens) for k, v in value.items()}
    return [resolve(v, tokens) for v in value] if isinstance(value, list) else value


def resolved(targets: DataFrame, wanted: list[str], column: str = "attrs") -> DataFrame:
    """``targets`` with ``column`` (JSON) resolved for the tokens ``wanted`` and then ``default``; null where no branch matches."""
    tokens = list(dict.fromkeys([*wanted, "default"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(column).to_pylist():
                try:
                    out.append(None if text is None else json.dumps(resolve(json.loads(text), tokens), separators=(",", ":"), ensure_ascii=False))
                except LookupError:
                    out.append(None)
            at = b.schema.names.index(column)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], names=b.schema.names)

    return map_batches(targets, run, targets.schema)

"""The change journal as a stream: numbering by state or by batch, and tails of growing files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.plans.ranges import numbered
from graphloom.sources.files import read_or_empty
from graphloom.sources.tables import stored

NUMBERED = "area string, generation long, path string"


def number_changes(changes: DataFrame) -> DataFrame:
    """Gives each area's changes (area, path) consecutive generations, across batches.

    The state is one number an area; the order within a batch is that of arrival, and an area
    is one task. ``journal_stream`` has neither limit.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            out = pd.DataFrame({"area": key[0], "generation": range(last + 1, last + 1 + len(pdf)), "path": pdf["path"].to_numpy()})
            last += len(pdf)
            yield out
        state.update((last,))

    grouped = changes.groupBy("area")
    return grouped.applyInPandasWithState(number, NUMBERED, "last long", "append", GroupStateTimeout.NoTimeout)


def journal_stream(changes: DataFrame, out: str, checkpoint: str, order: tuple[str, ...] = ("path",)) -> None:
    """Runs a stream of changes (area, path, ``order``) over all that is there now and appends (area, generation, path) to ``out``.

    Each batch is numbered in the given order by ranges, after the last generation of the
    batches before it, and written to a folder of its own, which a rerun of the batch
    overwrites: the same changes get the same numbers again.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        before = read_or_empty(batch.sparkSession, out, f"{NUMBERED}, batch long").filter(F.col("batch") < batch_id)
        last = before.groupBy("area").agg(F.max("generation").alias("_last"))  # one row an area
        placed = stored(numbered(batch, ["area", *order], "_pos"), "changes")
        first = placed.groupBy("area").agg(F.min("_pos").alias("_first")).join(last, "area", "left")
        both = placed.join(F.broadcast(first), "area")
        generation = F.col("_pos") - F.col("_first") + 1 + F.coalesce("_last", F.lit(0))
        both.select("area", generation.alias("generation"), "path").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the rows of line-delimited JSON files as files come into a folder."""
    return spark.readStream.schema(schema).json(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now and appends its rows to a Parquet folder."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    query.trigger(availableNow=True).start(out).awaitTermination()

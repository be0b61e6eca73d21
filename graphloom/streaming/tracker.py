"""The change tracker and the log tail as stateful streams.

Both keep their state in RocksDB by key, so a batch costs what it brings, whatever came before;
a restart goes on from the checkpoint with the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions.scalars import cursor
from graphloom.operators.journal import MAX_RECORDS, changes_since
from graphloom.sources.tables import known_to_workers

CHANGES = "instance string, area string, generation long, path string"
LINES = "source string, line long, message string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    known_to_workers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Numbering(StatefulProcessor):
    """Consecutive generations of an (instance, area); the newest are kept in a ring by generation."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "generation long")
        self.recent = handle.getMapState("recent", "place long", "generation long, path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            paths = [None if pd.isna(p) else p for p in frame["path"]]
            numbers = range(last + 1, last + 1 + len(paths))
            last += len(paths)
            for n, path in list(zip(numbers, paths, strict=True))[-self.most :]:
                self.recent.updateValue((n % self.most,), (n, path))
            self.last.update((last,))
            yield pd.DataFrame({"instance": key[0], "area": key[1], "generation": list(numbers), "path": pd.Series(paths, dtype=object)})

    def close(self) -> None:
        pass


def numbered_changes(changes: DataFrame, most: int = MAX_RECORDS) -> DataFrame:
    """(instance, area, generation, path) of a stream of changes (instance, area, path; a null path is a lost one)."""
    _use_rocksdb(changes.sparkSession)
    keyed = changes.select("instance", "area", "path").groupBy("instance", "area")
    return keyed.transformWithStateInPandas(_Numbering(most), CHANGES, outputMode="append", timeMode="none")


def tracked(spark: SparkSession, checkpoint: str, most: int = MAX_RECORDS) -> tuple[DataFrame, DataFrame]:
    """((instance, area, current), (instance, area, generation, path)): the state that a run of ``numbered_changes`` left.

    The second holds the newest ``most`` records of each area.
    """
    read = spark.read.format("statestore")
    last = read.option("stateVarName", "last").load(checkpoint).select("key.instance", "key.area", F.col("value.generation").alias("current"))
    recent = spark.read.format("statestore").option("stateVarName", "recent").load(checkpoint)
    recent = recent.select("key.instance", "key.area", F.col("user_map_value.generation").alias("generation"), F.col("user_map_value.path").alias("path"))
    return last, recent


def snapshot_since(spark: SparkSession, checkpoint: str, instance: str, area: str, since: tuple[str, int] | None) -> tuple[int, DataFrame | None]:
    """(current generation, (path) changed after ``since``): null paths for a position of another instance, of the future, or before what is kept.

    ``since``: the instance and generation of an earlier position, or None.
    """
    last, recent = tracked(spark, checkpoint)
    here = (F.col("instance") == instance) & (F.col("area") == area)
    got = last.filter(here).first()
    current = got["current"] if got else 0
    if since is None or since[0] != instance:
        return current, None
    found = changes_since(recent.filter(here), since[1], current)
    known = found.first()
    return current, found.filter("path IS NOT NULL").select("path") if known["known"] else None


class _Lines(StatefulProcessor):
    """Line numbers of a source, from 0, over all files it has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "line long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        files = pd.concat(list(rows)).sort_values(["modified", "path"])
        at = self.next.get()[0] if self.next.exists() else 0
        for text in files["text"]:
            lines = text.split("\n")
            lines = [line.removesuffix("\r") for line in (lines[:-1] if lines[-1] == "" else lines)]
            yield pd.DataFrame({"source": key[0], "line": range(at, at + len(lines)), "message": lines})
            at += len(lines)
        self.next.update((at,))

    def close(self) -> None:
        pass


def log_stream(spark: SparkSession, root: str, files_a_batch: int = 1_000) -> DataFrame:
    """(cursor, source, level, message): a stream of the lines of text files ``root/<source>/<file>``, as files come.

    A source's lines are numbered on from file to file, by time and then by path, and from
    batch to batch. A file is one value of a task, so writers should begin a new one now and
    then; a file that grows after it was read isn't read again. ``logs.matching_logs`` filters
    the stream as it does a table.
    """
    _use_rocksdb(spark)
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).load(root)
    path = F.col("_metadata.file_path")
    files = files.select(F.element_at(F.split(path, "/"), -2).alias("source"), path.alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    lines = files.groupBy("source").transformWithStateInPandas(_Lines(), LINES, outputMode="append", timeMode="none")
    level = F.when(F.col("source") == "stderr", "error").otherwise("info")
    return lines.select(cursor(F.col("source"), F.col("line")).alias("cursor"), "source", level.alias("level"), "message")

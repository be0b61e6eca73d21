"""Input tables, intermediate tables, and small helpers every operator uses."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read from Parquet so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets a new folder of its own; a cluster has none that
    all can see, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that a loop adds to round by round. However many rounds, reading it is one scan."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths, self.schema = spark, new_folder(spark, name), [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes one round's rows; gives them back as stored. ``added`` says how many they were."""
        path = f"{self.folder}/round-{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = self.schema or df.schema
        self.added = self.spark.read.schema(self.schema).parquet(path).count()  # from the files' footers
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class Current:
    """A table that a loop replaces round by round. What was replaced is deleted: nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def put(self, df: DataFrame, **counts: Column) -> DataFrame:
        """Writes the next round's rows, which may be made of the last one's; gives them back as stored.

        ``counts`` are aggregates over the rows; ``got`` has their values.
        """
        path, schema = f"{self.folder}/round-{self.n}", df.schema
        df.write.parquet(path)
        if counts:
            self.got = self.spark.read.schema(schema).parquet(path).agg(*[c.alias(n) for n, c in counts.items()]).first()
        if self.n:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/round-{self.n - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.n += 1
        return self.spark.read.schema(schema).parquet(path)


def known_to_workers(spark: SparkSession) -> None:
    """Puts this package's place on the path of the Python workers.

    Workers import what a function names from this package. On a cluster the package is
    installed or sent with --py-files; then the added place is merely not there.
    """
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(":")
    if here not in known:
        environment["PYTHONPATH"] = ":".join([here, *filter(None, known)])


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow``, with this package known to the workers."""
    known_to_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)

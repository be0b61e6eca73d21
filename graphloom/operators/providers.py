"""What targets hand on to those that depend on them: providers by role, and values over all dependencies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import carried
from graphloom.sources.tables import Rounds


def dependencies_by_role(targets: DataFrame, reachable: DataFrame) -> DataFrame:
    """(id, role, pos, dep, providers): the dependencies of each role in the order declared, numbered from 0.

    ``targets``: id, deps, dependencies (map of role to ids), providers. Dependencies that
    aren't among ``reachable`` (id) are left out, and don't count for the order.
    """
    plain = targets.select("id", F.lit("deps").alias("role"), F.posexplode("deps").alias("_i", "dep"))
    roles = targets.select("id", F.explode("dependencies").alias("role", "_deps")).select("id", "role", F.posexplode("_deps").alias("_i", "dep"))
    known = reachable.select(F.col("id").alias("dep")).distinct()
    given = targets.select(F.col("id").alias("dep"), "providers")
    order = Window.partitionBy("id", "role").orderBy("_i")
    kept = plain.unionAll(roles).join(known, "dep", "left_semi").join(given, "dep")
    return kept.select("id", "role", (F.row_number().over(order) - 1).cast("long").alias("pos"), "dep", "providers")


def collected(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value, hops): the values (id, value) of each target and of all it depends on, each value once, at its nearest place.

    ``edges``: src, dst. A target's own values have 0 hops; order by hops and value for a list.
    """
    got = carried(own.select(F.col("id").alias("node"), F.col("value").alias("item")), edges)
    return got.select(F.col("node").alias("id"), F.col("item").alias("value"), "hops")


class Functions:
    """User functions over dependency rows, by name. A name can be given once."""

    def __init__(self) -> None:
        self.known: dict = {}

    def register(self, name: str, function, schema: str) -> None:
        """``function(key, frame) -> frame`` gets the rows of one target as pandas; ``schema`` is that of what it returns."""
        if name in self.known:
            raise ValueError(f"a function {name} is registered already")
        self.known[name] = (function, schema)

    def apply(self, name: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """Runs a function once for each target over its rows, which Spark has shuffled together."""
        if name not in self.known:
            raise LookupError(f"no function {name}")
        function, schema = self.known[name]

        def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return function(keys[0], frame)

        return rows.groupBy(key).applyInPandas(run, schema)

    def expand(self, name: str, rows: DataFrame) -> DataFrame:
        """Runs a function as a table function: once for each batch of rows, any number of rows each."""
        if name not in self.known:
            raise LookupError(f"no function {name}")
        function, schema = self.known[name]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield function(None, frame)

        return rows.mapInPandas(run, schema)


def expanded(targets: DataFrame, functions: Functions, name: str, most: int = 100_000, key: str = "id") -> DataFrame:
    """``targets`` and all that a registered function makes of them, of what it made, and so on until nothing new comes.

    The function gives rows of the columns of ``targets``. ValueError for a key that comes
    twice, or if more than ``most`` rows would come of it.
    """
    all_of = Rounds(targets.sparkSession, "expanded")
    new = all_of.add(targets)
    n = new.count()
    while not new.isEmpty():
        new = all_of.add(functions.expand(name, new).select(*targets.columns))
        n += new.count()
        if n > most:
            raise ValueError(f"more than {most} targets")
        twice = all_of.all().groupBy(key).count().filter("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"declared twice: {[r[key] for r in twice]}")
    return all_of.all()

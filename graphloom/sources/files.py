"""Reading and writing record files: NDJSON, JSON documents, logs, manifests, append-only stores."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import included
from graphloom.sources.tables import map_batches

MANIFEST = "package string, path string, id string, name string, kind string, deps array<string>, srcs array<string>, visibility array<string>, attrs string"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet store, or no rows where none has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append(df: DataFrame, path: str, key: str = "id") -> None:
    """Appends records to a store; an id that repeats in ``df`` or is in the store is an error.

    For one writer at a time: two that append the same new id at once would both pass the check.
    """
    repeated = df.groupBy(key).count().filter("count > 1")
    known = read_or_empty(df.sparkSession, path, df.select(key).schema.simpleString()[7:-1].replace(":", " "))
    if not repeated.isEmpty() or not df.join(known, key, "left_semi").isEmpty():
        raise ValueError(f"a record's {key} is there already")
    df.write.mode("append").parquet(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line-delimited JSON; blank lines are skipped, a malformed line fails the read."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_sessions(spark: SparkSession, root: str, name: str = "session.json") -> DataFrame:
    """(session, document): the description of every session below a folder, by the folder's name, as its text. Spark lists no empty files, so they are no session."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("session"), F.decode("content", "UTF-8").alias("document"))


def write_by_target(df: DataFrame, path: str, key: str = "target") -> None:
    """JSON documents in a folder for each target."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def read_manifests(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), name: str = "manifest.toml") -> DataFrame:
    """Targets of all manifests below a folder: ``[[target]]`` tables with name, kind, deps, srcs, visibility, attrs.

    Files in folders that start with a dot are skipped; inclusions and exclusions are
    patterns over a package's path. A name or kind that isn't given is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/*", ""), f"\\A{base}/?", "")
    files = files.select(inner.alias("path"), "content").withColumn("package", F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1))
    files = files.filter(~F.col("path").rlike(r"(?:\A|/)\.") & included(F.col("package"), list(include), list(exclude)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        types = [pa.string()] * 5 + [strings] * 3 + [pa.string()]
        for b in batches:
            out: list[list] = [[] for _ in types]
            for path, content, package in zip(*(b.column(c).to_pylist() for c in ("path", "content", "package")), strict=True):
                for t in tomllib.loads(content.decode()).get("target", []):
                    name = t.get("name")  # a target without a name or kind is left to the rules
                    ident = f"{package}/{name or ''}" if package else name
                    row = (package, path, ident, name, t.get("kind"), *(t.get(k, []) for k in ("deps", "srcs", "visibility")), json.dumps(t.get("attrs", {}), sort_keys=True, default=str))
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=names)

    return map_batches(files, parse, MANIFEST).orderBy("package", "path")


def marker_projects(paths: DataFrame, markers: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(package, project), in order: folders that hold every marker file (project, marker) of a project.

    ``rules`` (project, max_depth, exclude array, stop boolean) bound how deep folders may lie
    and which names they may not have; of a project with ``stop`` only the shallowest folder
    of each branch stays. Folders whose name starts with a dot never count.
    """
    folder, file = F.regexp_extract("path", r"\A(.*?)/?[^/]*\z", 1), F.element_at(F.split("path", "/"), -1)
    wanted = markers.groupBy("project").agg(F.count_distinct("marker").alias("_all"))
    seen = paths.filter(~F.col("path").rlike(r"(?:\A|/)\."))
    held = seen.select(folder.alias("package"), file.alias("marker")).join(markers, "marker")
    got = held.groupBy("package", "project").agg(F.count_distinct("marker").alias("_n")).join(wanted, "project").filter("_n = _all").select("package", "project")
    if rules is not None:
        parts = F.filter(F.split("package", "/"), lambda p: p != "")
        bounded = got.join(rules, "project").filter((F.size(parts) < F.col("max_depth")) & ~F.arrays_overlap(parts, "exclude"))
        up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        above = bounded.filter(F.col("stop") & (F.size(parts) > 0)).select("project", "package", F.explode(up).alias("_up"))
        inner = above.join(bounded.select("project", F.col("package").alias("_up")), ["project", "_up"], "left_semi")
        got = bounded.join(inner.select("project", "package").distinct(), ["project", "package"], "left_anti").select("package", "project")
    return got.orderBy("package", "project")


def project_package(found: DataFrame, project: str, package: str | None = None) -> str:
    """The folder of a project: the one given, else the only one. LookupError if there is none, ValueError if several."""
    rows = found.filter(F.col("project") == project)
    rows = rows if package is None else rows.filter(F.col("package") == package)
    some = rows.orderBy("package").limit(2).collect()
    if not some:
        raise LookupError(f"no project {project}")
    if len(some) > 1:
        raise ValueError(f"project {project} is in several folders")
    return some[0]["package"]


def bounded_texts(files: DataFrame, each: int = 16 << 20, all_of: int = 64 << 20) -> DataFrame:
    """(owner, path, text): the texts that owners (owner, path, text) read. ValueError if one, or an owner's sum, is too large."""
    sized = files.withColumn("_n", F.octet_length("text"))
    over = sized.groupBy("owner").agg(F.max("_n").alias("one"), F.sum("_n").alias("all")).filter((F.col("one") > each) | (F.col("all") > all_of))
    bad = over.select("owner").limit(5).collect()
    if bad:
        raise ValueError(f"inputs too large: {[r['owner'] for r in bad]}")
    return files.select("owner", "path", "text")

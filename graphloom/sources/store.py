"""A content-addressed store as files: buckets of blobs and records, and walks of store folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import read_or_empty

#: Characters of a digest that name its bucket: 256 buckets.
SHARD = 2


def _bucket(key: str):
    return F.substring(F.sha2(F.col(key).cast("string"), 256), 1, SHARD)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def put(df: DataFrame, path: str, key: str = "digest") -> DataFrame:
    """Adds the rows of ``df`` whose key the store hasn't; gives back the rows that were added.

    Rows go to the bucket of their key, and only the buckets that ``df`` has rows for are read.
    Nothing is overwritten, so a repeat adds nothing and two writers lose nothing: what both
    add at once is one row to those who read (``contents``), and in the files after ``compacted``.
    Rows without a key are not kept.
    """
    rows = df.filter(F.col(key).isNotNull()).withColumn("bucket", _bucket(key))
    order = F.struct(*[c for c in df.columns if c != key])
    rows = rows.groupBy(key, "bucket").agg(F.min(order).alias("_first")).select(key, "_first.*", "bucket").select(*df.columns, "bucket")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # 16**SHARD at most
    known = read_or_empty(df.sparkSession, path, f"{_columns(df.select(key))}, bucket string").filter(F.col("bucket").isin(touched))
    fresh = rows.join(known, [key, "bucket"], "left_anti").select(*df.columns, "bucket")
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return fresh.drop("bucket")


def append_records(df: DataFrame, path: str, key: str = "id") -> None:
    """Appends records; an id with other contents than the store's, or twice with different contents in ``df``, is an error.

    The same record may come again. Of records with one id that two writers add at once,
    those who read get the same one, always.
    """
    body = F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    twice = df.select(key, body.alias("_b")).distinct().groupBy(key).count().filter("count > 1")
    known = contents(df.sparkSession, path, _columns(df), key).select(F.col(key), body.alias("_old"))
    other = df.select(key, body.alias("_b")).join(known, key).filter("_b <> _old")
    bad = twice.select(key).unionAll(other.select(key)).limit(5).collect()
    if bad:
        raise ValueError(f"there already with other contents: {[r[key] for r in bad]}")
    put(df, path, key)


def contents(spark: SparkSession, path: str, schema: str, key: str = "digest") -> DataFrame:
    """The rows of a store, one for each key; no rows where nothing has been put."""
    rows = read_or_empty(spark, path, f"{schema}, bucket string")
    values = [c for c in rows.columns if c not in (key, "bucket")]
    return rows.groupBy(key).agg(F.min(F.struct(*values)).alias("_v")).select(key, "_v.*").select(*[c for c in rows.columns if c != "bucket"])


def compacted(spark: SparkSession, path: str, schema: str, key: str = "digest") -> None:
    """Rewrites the buckets that hold a key more than once, each as a whole, and leaves the others as they are.

    For times when nobody puts: what is put to a bucket while it is rewritten may be lost.
    """
    rows = read_or_empty(spark, path, f"{schema}, bucket string")
    twice = [r["bucket"] for r in rows.groupBy("bucket", key).count().filter("count > 1").select("bucket").distinct().collect()]
    if twice:
        values = [c for c in rows.columns if c not in (key, "bucket")]
        once = rows.filter(F.col("bucket").isin(twice)).groupBy("bucket", key).agg(F.min(F.struct(*values)).alias("_v"))
        once = once.select(key, "_v.*", "bucket").select(*rows.columns).repartition("bucket")
        once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of all files below a folder that aren't a writer's unfinished ones; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith(".tmp-"))


def walk_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(path, digest, size, modified) of the blobs of a store folder; a path that is no address ``aa/rest`` has no digest.

    Spark lists no files without bytes: the blob of the empty content, and an action file cut to nothing, are not seen.
    """
    parts = F.split("path", "/")
    name, shard = F.element_at(parts, -1), F.element_at(parts, -2)
    whole = F.concat(shard, name)
    digest = F.when((F.length(shard) == SHARD) & whole.rlike(r"\A[0-9a-f]{64}\z"), whole)
    millis = F.unix_millis("modificationTime")
    return _files(spark, root).select("path", digest.alias("digest"), F.col("length").alias("size"), millis.alias("modified"))


def walk_actions(spark: SparkSession, root: str) -> DataFrame:
    """(id, size, modified, refs) of the action results of a store folder; a corrupt or foreign file refers to nothing."""
    files = _files(spark, root).filter(F.col("path").endswith(".json"))
    text = F.decode("content", "UTF-8")
    schema = "exit_code int, stdout string, stderr string, outputs map<string,string>"
    got = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    refs = F.filter(F.concat(F.coalesce(F.map_values(got["outputs"]), F.array().cast("array<string>")), F.array(got["stdout"], got["stderr"])), lambda r: r.isNotNull())
    sound = F.try_parse_json(text).isNotNull() & got["exit_code"].isNotNull() & F.forall(refs, lambda r: r.rlike(r"\A[0-9a-f]{64}\z"))
    millis = F.unix_millis("modificationTime")
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("id"), F.col("length").alias("size"), millis.alias("modified"),
        F.when(F.coalesce(sound, F.lit(False)), refs).otherwise(F.array().cast("array<string>")).alias("refs"),
    )


def references(actions: DataFrame) -> DataFrame:
    """(id, ref): one row for each reference of an action of ``walk_actions``."""
    return actions.select("id", F.explode("refs").alias("ref"))

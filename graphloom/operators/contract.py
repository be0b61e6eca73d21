"""Audit of what an action did to files, from listings before and after it.

A listing has action, path and print (a fingerprint; ``dir`` for a folder). Declared paths
(action, path) cover what lies under them. All joins are by action and path: a path is
exploded to itself and the folders above it and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def above(df: DataFrame) -> DataFrame:
    """``df`` (action, path, ...) once for the path itself and for each folder above it, as ``_up``."""
    parts = F.split("path", "/")
    return df.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def covered(df: DataFrame, declared: DataFrame) -> DataFrame:
    """(action, path) of the rows of ``df`` that are declared or lie under a declared path."""
    said = declared.select("action", F.rtrim("path", F.lit("/")).alias("_up")).distinct()
    return above(df.select("action", "path").distinct()).join(said, ["action", "_up"]).select("action", "path").distinct()


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, path, old, new) of paths whose fingerprints differ or that one listing lacks."""
    a, b = before.select("action", "path", F.col("print").alias("old")), after.select("action", "path", F.col("print").alias("new"))
    return a.join(b, ["action", "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def violations(inputs: DataFrame, outputs: DataFrame, private: tuple[DataFrame, DataFrame], shared: tuple[DataFrame, DataFrame], errors: DataFrame, links: DataFrame) -> DataFrame:
    """(action, code, path), each once: where actions broke what they declared.

    ``private`` and ``shared``: listings before and after of an action's own folder and of
    the workspace. ``errors``: action and text, the error output of failed actions.
    ``links``: action, path, inside - links among the outputs and if they stay inside.

    * undeclared_write: a path changed that is neither an output, under one, nor a folder
      above one (own folder), or neither an output nor an input (workspace);
    * missing_output: a declared output isn't there;
    * declared_input_deleted, declared_input_modified: an input went or changed;
    * symlink_escape: a link among the outputs leads outside;
    * undeclared_read: the error output of a failed action names a file that isn't declared.
    """
    outs = outputs.select("action", F.rtrim("path", F.lit("/")).alias("path")).distinct()
    ins = inputs.select("action", "path").distinct()
    key = ["action", "path"]

    own = changed(*private)
    parents = above(outs).select("action", F.col("_up").alias("path")).distinct()
    wrote = own.select(*key).join(covered(own, outs), key, "left_anti").join(parents, key, "left_anti")
    work = changed(*shared)
    wrote = wrote.unionAll(work.select(*key).join(ins, key, "left_anti").join(covered(work, outs), key, "left_anti"))

    missing = outs.join(private[1].select(*key), key, "left_anti")
    of_inputs = work.join(ins, key, "left_semi")
    deleted, modified = of_inputs.filter("new IS NULL"), of_inputs.filter("new IS NOT NULL")
    escaped = links.filter(~F.col("inside")).select(*key)

    files = shared[0].filter("print <> 'dir'").select(*key).distinct()
    files = files.join(covered(files, ins), key, "left_anti").join(covered(files, outs), key, "left_anti")
    # A text is cut into what can be a path; a file is read if its path is one of these parts.
    words = errors.select("action", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_./-]+"), F.lit(0))).alias("path")).distinct()
    read = files.join(words, key, "left_semi")

    named = (("undeclared_write", wrote), ("missing_output", missing), ("declared_input_deleted", deleted), ("declared_input_modified", modified), ("symlink_escape", escaped), ("undeclared_read", read))
    out = None
    for code, rows in named:
        part = rows.select("action", F.lit(code).alias("code"), "path")
        out = part if out is None else out.unionAll(part)
    return out.distinct()

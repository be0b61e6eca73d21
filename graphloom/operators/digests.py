"""Order-independent and ordered digests, fingerprints, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(domain: str, parts: Column) -> Column:
    """Digest of a domain and (label, digest) pairs in the order given, each part closed by a line end."""
    lines = F.transform(parts, lambda p: F.concat(p["label"], F.lit("\n"), p["digest"], F.lit("\n")))
    return F.sha2(F.concat(F.lit(domain), F.lit("\n"), F.array_join(lines, "")), 256)


def set_digest(rows: DataFrame, key: str, label, line, domain: str) -> DataFrame:
    """(key, digest, n): digest of a group's lines in order of label and line, whatever the rows' order.

    Taken in two steps: a group's rows are dealt to 4,096 parts by a digest of their label,
    each part is sorted and digested, then the parts' digests are folded. So the rows of a
    group never meet in one task.
    """
    parts = rows.select(F.col(key), F.substring(F.sha2(label, 256), 1, 3).alias("_part"), label.alias("_label"), line.alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_label", "_line"))), lambda p: F.concat(p["_line"], F.lit("\n")))
    parts = parts.groupBy(key, "_part").agg(F.sha2(F.array_join(lines, ""), 256).alias("_digest"), F.count(F.lit(1)).alias("_n"))
    folded = F.array_sort(F.collect_list(F.struct(F.col("_part").alias("label"), F.col("_digest").alias("digest"))))
    return parts.groupBy(key).agg(_fold(domain, folded).alias("digest"), F.sum("_n").alias("n"))


def fingerprint(components: DataFrame, key: str, domain: str = "fingerprint") -> DataFrame:
    """(key, digest, n): digest of a group's components (label, digest), whatever their order."""
    return set_digest(components, key, F.col("label"), F.concat_ws(" ", "label", "digest"), domain)


def category_counts(components: DataFrame, key: str = "category") -> DataFrame:
    """(key, n): components of each category."""
    return components.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def env_digest(name: Column, value: Column) -> Column:
    """Digest of an environment variable: its name, a zero character and its value; one that is unset has none."""
    return F.sha2(F.concat(name, F.lit("\0"), value), 256)


def input_spec(spec: Column) -> Column:
    """(kind, name, value) of an input: ``env:NAME=value`` or ``env:NAME``, ``value:name=value``, else a path."""
    kind = F.when(spec.startswith("env:"), "env").when(spec.startswith("value:"), "value").otherwise("path")
    body = F.when(kind == "path", spec).otherwise(F.regexp_replace(spec, r"\A(?:env|value):", ""))
    named = (kind != "path") & body.contains("=")
    name = F.when(named, F.regexp_extract(body, r"\A([^=]*)=", 1)).otherwise(body)
    value = F.when(named, F.regexp_replace(body, r"\A[^=]*=", ""))
    return F.struct(kind.alias("kind"), name.alias("name"), value.alias("value"))


def drifted(expected: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key): expected keys whose value now differs or is gone; keys that only ``current`` has don't count."""
    now = current.select(key, F.col(value).alias("_now"))
    return expected.select(key, value).join(now, key, "left").filter(~F.col(value).eqNullSafe(F.col("_now"))).select(key)


def target_digest(digests: DataFrame, key: str) -> DataFrame:
    """(key, digest): a lone digest itself, else the fold of all in order of their index."""
    got = digests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("_d"))
    parts = F.transform("_d", lambda d: F.struct(d["index"].cast("string").alias("label"), d["digest"].alias("digest")))
    return got.select(key, F.when(F.size("_d") == 1, F.get("_d", F.lit(0))["digest"]).otherwise(_fold("target", parts)).alias("digest"))


def cache_state(rows: DataFrame, key: str) -> DataFrame:
    """(key, cache): the worst state of a group: bypass over miss over hit."""
    rank = F.when(F.col("cache") == "bypass", 2).when(F.col("cache") == "miss", 1).otherwise(0)
    return rows.groupBy(key).agg(F.max_by("cache", rank).alias("cache"))


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of the keys whose values differ or that one side lacks."""
    a, b = left.select(key, F.col(value).alias("before")), right.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def tree_manifest(files: DataFrame, key: str) -> DataFrame:
    """(key, digest): digest of the lines ``digest  path`` of a tree in order of path."""
    return set_digest(files, key, F.col("path"), F.concat_ws("  ", "digest", "path"), "tree").select(key, "digest")


def unchanged_digests(current: DataFrame, cached: DataFrame, key: str, stat: list[str]) -> DataFrame:
    """``current`` with the cached digest where every stat column is equal, else null."""
    c = cached.select(F.col(key).alias("_k"), "digest", *[F.col(s).alias(f"_{s}") for s in stat])
    same = F.col(key) == F.col("_k")
    for s in stat:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return current.join(c, same, "left").select(*[current[x] for x in current.columns], "digest")

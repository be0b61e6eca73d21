"""Annotations at the head of scripts, and the graph of scripts that need each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import closure, cycles

#: What starts a comment, and what an annotation may say.
COMMENT = r"(?:#|//|;|--|%|')"
DIRECTIVES = ("input", "needs", "fingerprint", "output", "env", "cwd", "remote", "output-symlinks")
MARKER = "task"


def head(text: Column, marker: str = MARKER) -> Column:
    """The lines after the first that are blank, comments or annotations, up to the first that isn't, trimmed."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    other = F.transform(rest, lambda line: ~((line == "") | line.rlike(r"\A" + COMMENT)))
    stop = F.array_position(other, True)
    return F.when(stop == 0, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))


def annotations(scripts: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, pos, directive, value) of the annotations of scripts (path, text), in order.

    An annotation is a comment like ``# task needs "a/b.sh"``. A directive that isn't known,
    or a value that isn't one quoted text, has the directive ``invalid`` and the whole line.
    """
    says = r"\A" + COMMENT + r"\s*(?i:" + marker + r")(?:\s+(.*))?\z"
    noted = scripts.select("path", F.posexplode(F.filter(head(F.col("text"), marker), lambda line: line.rlike(says))).alias("pos", "line"))
    body = F.coalesce(F.regexp_extract("line", says, 1), F.lit(""))
    known = r"\A(" + "|".join(DIRECTIVES) + r')\s+"([^"]*)"\s*\z'
    name = F.regexp_extract(body, known, 1)
    return noted.select(
        "path", F.col("pos").cast("long").alias("pos"), F.when(name == "", "invalid").otherwise(name).alias("directive"),
        F.when(name == "", F.col("line")).otherwise(F.regexp_extract(body, known, 2)).alias("value"),
    )


def runtimes(scripts: DataFrame) -> DataFrame:
    """(path, runtime, args): what a script's first line runs it with; null where it doesn't start with ``#!``.

    After ``env`` the first word that isn't an option is the runtime.
    """
    first = F.get(F.split("text", r"\r?\n"), F.lit(0))
    words = F.filter(F.split(F.regexp_replace(first, r"\A#!", ""), r"\s+"), lambda w: w != "")
    via_env = F.get(words, F.lit(0)).rlike(r"(?:\A|/)env\z")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    at = F.array_position(F.transform(rest, lambda w: ~w.startswith("-")), True)
    after = F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(rest, at.cast("int"), F.size(rest)))
    chosen = F.when(via_env, after).otherwise(words)
    args = F.slice(chosen, 2, F.greatest(F.size(chosen) - 1, F.lit(0)))
    return scripts.select("path", *[F.when(first.startswith("#!"), c).alias(n) for n, c in (("runtime", F.get(chosen, F.lit(0))), ("args", args))])


def needs(notes: DataFrame) -> DataFrame:
    """(src, dst): which script needs which, from ``annotations``."""
    return notes.filter("directive = 'needs'").select(F.col("path").alias("src"), F.col("value").alias("dst")).distinct()


def needed_scripts(notes: DataFrame, roots: DataFrame) -> DataFrame:
    """(start, node): the scripts that each root (start) needs, over any number of steps. Raises ValueError on a cycle among them."""
    edges = needs(notes)
    found = closure(edges, roots).select("start", "node")
    inside = edges.join(found.unionAll(roots.select("start", F.col("start").alias("node"))).select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    ring = cycles(inside).orderBy("node").limit(5).collect()
    if ring:
        raise ValueError(f"scripts need each other: {[r['node'] for r in ring]}")
    return found

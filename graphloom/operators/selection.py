"""Change-impact selection: paths to owners to dependents, with reasons; batches and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import glob_regex, is_glob, matches_any, normalise_path, parent, usable_pattern
from graphloom.operators.digests import set_digest
from graphloom.plans.fixpoint import reached_from, reverse_closure
from graphloom.sources.tables import stored

#: The manifest at the root: a change of it changes the graph.
DEFINITION = "manifest.toml"


#: Characters of the pieces of text that patterns without folder or ending are found by.
GRAM = 3
#: Parts that paths are dealt to for patterns that say nothing a path must hold.
SPREAD = 32


def pattern_owners(changed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, id): targets (id, pattern) with a declared pattern that a changed path matches.

    Absolute patterns and those that go up match nothing. Patterns without wildcards join by
    equality. Others join on their literal directory (the part before the first wildcard, up
    to a slash), or else on the extension they end in, or else on the rarest ``GRAM``
    characters of what they say between wildcards; the rest is matched by regular expression.
    """
    changed = changed.select("path").distinct()
    pattern = F.col("pattern")
    patterns = patterns.filter(usable_pattern(pattern))
    exact = patterns.filter(~is_glob(pattern)).join(changed, F.regexp_replace(pattern, r"\A(?:\./)+", "") == F.col("path")).select("path", "id")
    folder = F.regexp_extract("pattern", r"\A((?:[^*?\[/]*/)+)", 1)
    ending = F.regexp_extract("pattern", r"(\.[^.*?\[\]/]+)\z", 1)
    key = F.when(folder != "", folder).when(ending != "", F.concat(F.lit("*"), ending))
    globs = patterns.filter(is_glob(pattern)).withColumn("_key", key).withColumn("_rx", glob_regex(pattern))
    keyed = globs.filter(F.col("_key").isNotNull())
    own = F.array(F.concat(F.lit("*"), F.regexp_extract("path", r"(\.[^./]+)\z", 1)))
    above = changed.withColumn("_key", F.explode(F.array_distinct(F.concat(own, directories(F.col("path"))))))
    out = exact.unionAll(above.join(keyed, "_key").filter(F.regexp_like("path", F.col("_rx"))).select("path", "id"))
    loose = globs.filter(F.col("_key").isNull()).select("id", "pattern", "_rx")
    return (out if loose.isEmpty() else out.unionAll(_by_literal(changed, loose))).distinct()


def _grams(text: Column, length: int) -> Column:
    """The distinct pieces of a text of so many characters."""
    n = F.length(text) - length + 1
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(length)))
    return F.when(n >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _by_literal(changed: DataFrame, loose: DataFrame) -> DataFrame:
    """(path, id) for patterns (id, pattern, _rx) that name no folder and no ending.

    Every path that matches holds all of a pattern's literal text, so it is met by the gram of it
    that the fewest paths hold; a pattern with a gram that no path holds matches nothing. ``**/``
    may stand for nothing, so a slash after it is no literal. Texts shorter than a gram, and
    patterns of wildcards only, meet every path, dealt to ``SPREAD`` parts.
    """
    said = F.split(F.regexp_replace("pattern", r"\*\*/", "*"), r"[*?]+|\[[^\]]*\]")
    loose = loose.select("id", "_rx", F.monotonically_increasing_id().alias("_p"), F.array_distinct(F.flatten(F.transform(said, lambda t: _grams(t, GRAM)))).alias("_grams"))
    loose = stored(loose, "loose")
    grams = stored(changed.select("path", F.explode(_grams(F.col("path"), GRAM)).alias("_gram")), "grams")
    wanted = loose.select("_p", F.explode("_grams").alias("_gram"))
    held = grams.join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(held, "_gram", "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_g"))
    rarest = rarest.filter("_g.n > 0").select("_p", F.col("_g._gram").alias("_gram")).join(loose, "_p")
    by_gram = grams.join(rarest, "_gram").select("path", "id", "_rx")
    silent = loose.filter(F.size("_grams") == 0).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = changed.withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int"))
    every = dealt.join(silent, "_s").select("path", "id", "_rx")
    return by_gram.unionAll(every).filter(F.regexp_like("path", F.col("_rx"))).select("path", "id")


def directories(path: Column) -> Column:
    """Every directory above a path, with its closing slash."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, up).otherwise(none)


def nearest_packages(changed: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, package, id): all targets of the deepest package that holds a path's directory.

    The root package '' holds files at the root only, manifests included. Prefixes of
    directories join packages by equality.
    """
    packages = targets.select("package").distinct()
    parts = F.split(parent(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = changed.select("path").distinct().withColumn("package", F.explode(up)).join(packages, "package")
    best = held.groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))
    return best.join(targets.select("package", "id"), "package").select("path", "package", "id")


def unmatched(changed: DataFrame, owners: DataFrame) -> DataFrame:
    """Changed paths without an owner."""
    return changed.select("path").distinct().join(owners.select("path").distinct(), "path", "left_anti")


def owners_of(changed: DataFrame, patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, id): a declared pattern decides who owns a path, the nearest package only where none matches."""
    declared = pattern_owners(changed, patterns)
    near = nearest_packages(unmatched(changed, declared), targets)
    return declared.unionAll(near.select("path", "id")).distinct()


def graph_changes(changed: DataFrame, definitions: list[str]) -> DataFrame:
    """Changed paths that define the graph: the root manifest and configured modules (patterns)."""
    return changed.filter(matches_any(F.col("path"), definitions)) if definitions else changed.limit(0)


def full_scope(changed: DataFrame, patterns: DataFrame, targets: DataFrame, definitions: list[str] = (DEFINITION,)) -> DataFrame:
    """(path, reason) of the changed paths for which every test runs: definitions of the graph, and paths without an owner."""
    changed = changed.select(normalise_path(F.col("path")).alias("path")).distinct()
    defines = graph_changes(changed, list(definitions))
    rest = changed.join(defines, "path", "left_anti")
    lost = unmatched(rest, owners_of(rest, patterns, targets))
    return defines.withColumn("reason", F.lit("graph definition")).unionAll(lost.withColumn("reason", F.lit("no owner")))


def affected(changed: DataFrame, patterns: DataFrame, targets: DataFrame, edges: DataFrame, tests: DataFrame, definitions: list[str] = (DEFINITION,)) -> DataFrame:
    """(id, reasons, full_scope): the tests to run for changed paths, with sorted distinct reasons of their own.

    Without changed paths, or if ``full_scope`` has a path, all tests run; the flag says so
    once, and the paths are not repeated for each test.
    """
    tests = tests.select("id").distinct()
    changed = stored(changed.select(normalise_path(F.col("path")).alias("path")).distinct(), "changed")
    if changed.isEmpty():
        return tests.select("id", F.lit("full run").alias("reasons"), F.lit(True).alias("full_scope"))
    defines = graph_changes(changed, list(definitions))
    rest = changed.join(defines, "path", "left_anti")
    owners = stored(owners_of(rest, patterns, targets), "owners")
    every = not defines.unionAll(unmatched(rest, owners)).isEmpty()
    # along what tests depend on only: pairs that end in no test don't arise
    lead = stored(reached_from(edges, tests.select(F.col("id").alias("node"))), "lead")
    within = edges.join(lead.withColumnRenamed("node", "src"), "src", "left_semi").join(lead.withColumnRenamed("node", "dst"), "dst", "left_semi")
    reached = reverse_closure(within, owners.select(F.col("id").alias("start")).distinct())
    hit = reached.join(owners.withColumnRenamed("id", "start"), "start").join(tests.withColumnRenamed("id", "node"), "node")
    reason = F.when(F.col("hops") == 0, F.concat(F.lit("owns "), F.col("path"))).otherwise(F.concat(F.lit("depends on "), F.col("start"), F.lit(" for "), F.col("path")))
    own = hit.groupBy(F.col("node").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(reason)), "; ").alias("reasons"))
    out = tests.join(own, "id", "left" if every else "inner")
    return out.select("id", F.coalesce("reasons", F.lit("")).alias("reasons"), F.lit(every).alias("full_scope"))


def file_batches(units: DataFrame) -> DataFrame:
    """(target, batch, units): one batch a file; one for the whole target if any unit has no file."""
    whole = units.groupBy("target").agg(F.bool_or(F.col("file").isNull() | (F.col("file") == "")).alias("_whole"))
    named = units.join(whole, "target").withColumn("batch", F.when(F.col("_whole"), F.col("target").cast("string")).otherwise(F.col("file")))
    return named.groupBy("target", "batch").agg(F.array_join(F.sort_array(F.collect_set("unit")), ",").alias("units"))


def plan_id(paths: DataFrame, domain: str = "plan") -> DataFrame:
    """One row: an id that depends on the set of paths, not on their order or repetition."""
    whole = paths.select(F.lit(domain).alias("_plan"), "path").distinct()
    return set_digest(whole, "_plan", F.col("path"), F.col("path"), domain).select(F.col("digest").alias("plan_id"))


def batch_id(target: Column, filters: Column) -> Column:
    """Id of a batch: the same for the same target and set of filters, whatever plan it is in."""
    pair = F.concat(F.regexp_replace(F.to_json(F.array(target.cast("string"))), r"\]\z", ","), F.to_json(F.array_sort(F.array_distinct(filters))), F.lit("]"))
    return F.sha2(F.concat(F.lit("test-batch\0"), pair), 256)


def plan_lines(changed: DataFrame, unmatched_paths: DataFrame, tests: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """(section, key, line): the plan document, an entry a line as JSON; in order of section and key it is the same for equal plans.

    ``changed`` and ``unmatched_paths``: path; ``tests``: id, kind, reasons (array);
    ``batches``: target, filters (array), or none for a batch of each test. Entries are
    distinct, reasons and filters sorted and distinct; reasons of rows of one test are put
    together. Sort by section and key to write it.
    """
    paths = [
        df.select(F.lit(section).alias("section"), F.col("path").alias("key"), F.to_json(F.struct("path")).alias("line")).distinct()
        for section, df in (("changed", changed), ("unmatched", unmatched_paths))
    ]
    reason = tests.select("id", "kind", F.explode_outer("reasons").alias("_reason")).groupBy("id", "kind").agg(F.array_sort(F.collect_set("_reason")).alias("reasons"))
    of_tests = reason.select(F.lit("tests").alias("section"), F.concat_ws("\0", "id", "kind").alias("key"), F.to_json(F.struct("id", "kind", "reasons")).alias("line"))
    if batches is None:
        batches = tests.select(F.col("id").alias("target"), F.array().cast("array<string>").alias("filters"))
    listed = batches.select(F.col("target").cast("string").alias("target"), F.array_sort(F.array_distinct("filters")).alias("test_filters"))
    listed = listed.withColumn("id", batch_id(F.col("target"), F.col("test_filters"))).distinct()
    of_batches = listed.select(F.lit("batches").alias("section"), F.col("id").alias("key"), F.to_json(F.struct("id", "target", "test_filters")).alias("line"))
    return paths[0].unionAll(paths[1]).unionAll(of_tests).unionAll(of_batches)


def document_id(lines: DataFrame, domain: str = "test-plan") -> DataFrame:
    """One row (plan_id, entries): an id of the plan document (``plan_lines``), taken in parts, so it is never in one task."""
    whole = lines.withColumn("_plan", F.lit(domain))
    return set_digest(whole, "_plan", F.concat_ws("\0", "section", "key"), F.col("line"), domain).select(F.col("digest").alias("plan_id"), F.col("n").alias("entries"))


def restore_plan_order(completed: DataFrame, plan: DataFrame) -> DataFrame:
    """``completed`` (batch_id, ...) in the order of the plan (batch_id, position), with the position."""
    return completed.join(plan.select("batch_id", "position"), "batch_id").orderBy("position")


def batches_by_target(plan: DataFrame) -> DataFrame:
    """(target, pos, batch_id): the batches of each target in the plan's order, numbered from 1."""
    order = Window.partitionBy("target").orderBy("position", "batch_id")
    return plan.select("target", F.row_number().over(order).cast("long").alias("pos"), "batch_id")


def planned_units(targets: DataFrame, units: DataFrame, target: str | None = None, unit: str | None = None) -> DataFrame:
    """(target, batch, units): the batches of all tests, of one target, or of one of its units.

    A target without known units is one batch. Raises LookupError for an unknown target or unit.
    """
    if target is not None:
        targets = targets.filter(F.col("id") == target)
        if targets.isEmpty():
            raise LookupError(f"no target {target}")
    chosen = units.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    if unit is not None:
        chosen = chosen.filter(F.col("unit") == unit)
        if chosen.isEmpty():
            raise LookupError(f"no unit {unit}")
    bare = targets.select(F.col("id").alias("target")).distinct().join(units.select("target"), "target", "left_anti")
    return file_batches(chosen).unionAll(bare.select("target", F.col("target").cast("string").alias("batch"), F.lit("").alias("units")))

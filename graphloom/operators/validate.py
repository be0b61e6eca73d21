"""Data-quality rules over targets: each gives (code, target, attribute, message) rows.

Tables of kinds (schemas, roles, limits) are joined without hints: Spark broadcasts them if
they are small.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import relative_reference
from graphloom.operators.selection import pattern_owners
from graphloom.plans.fixpoint import cycle_paths, cycles
from graphloom.sources.tables import map_batches

NAME = r"\A[A-Za-z0-9][A-Za-z0-9_.+-]*\z"


def _found(rows: DataFrame, code: str, attribute: Column | None, message: Column, target: str = "id") -> DataFrame:
    attribute = F.lit(None).cast("string") if attribute is None else attribute
    return rows.select(F.lit(code).alias("code"), F.col(target).alias("target"), attribute.alias("attribute"), message.alias("message"))


def duplicate_targets(targets: DataFrame) -> DataFrame:
    twice = targets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _found(twice, "duplicate_target", None, F.concat(F.lit("declared "), F.col("n").cast("string"), F.lit(" times")))


def _named(targets: DataFrame) -> DataFrame:
    return targets.select("id", "package", F.explode("deps").alias("dep"))


def _edges(targets: DataFrame) -> DataFrame:
    """(id, kind, role, attribute, dep) of all dependencies: ``deps``, and the named roles of a map ``dependencies`` if there is one."""
    plain = targets.select("id", "kind", F.lit("deps").alias("role"), F.explode("deps").alias("dep"))
    if "dependencies" in targets.columns:
        roles = targets.select("id", "kind", F.explode("dependencies").alias("role", "_deps"))
        plain = plain.unionAll(roles.select("id", "kind", "role", F.explode("_deps").alias("dep")))
    attribute = F.when(F.col("role") == "deps", "deps").otherwise(F.concat(F.lit("dependencies."), F.col("role")))
    return plain.withColumn("attribute", attribute)


def missing_dependencies(targets: DataFrame) -> DataFrame:
    lost = _edges(targets).join(targets.select(F.col("id").alias("dep")).distinct(), "dep", "left_anti")
    return _found(lost, "missing_dependency", F.col("attribute"), F.concat(F.lit("no target "), F.col("dep")))


def _accepted(roles: DataFrame) -> DataFrame:
    """(kind, role, accepts): the declared roles, and ``deps`` of a kind that declares others only: all that these accept."""
    own = roles.select("kind", "role", "accepts")
    has = own.filter("role = 'deps'").select("kind")
    all_of = own.groupBy("kind").agg(F.array_distinct(F.flatten(F.collect_list("accepts"))).alias("accepts"))
    return own.unionAll(all_of.join(has, "kind", "left_anti").select("kind", F.lit("deps").alias("role"), "accepts"))


def _dependencies_of_declared_roles(targets: DataFrame, roles: DataFrame) -> DataFrame:
    """Dependencies that exist, with what their role accepts. Named roles that a kind doesn't declare are left out."""
    edges = _edges(targets).join(targets.select(F.col("id").alias("dep"), F.col("providers").alias("_given")), "dep")
    both = edges.join(_accepted(roles), ["kind", "role"], "left").filter(F.col("accepts").isNotNull() | (F.col("role") == "deps"))
    return both.withColumn("accepts", F.coalesce("accepts", F.array().cast("array<string>")))


def unexpected_dependencies(targets: DataFrame, roles: DataFrame) -> DataFrame:
    """Dependencies of kinds or roles (kind, role, accepts) that accept no provider at all."""
    bad = _dependencies_of_declared_roles(targets, roles).filter(F.size("accepts") == 0)
    return _found(bad, "unexpected_dependency", F.col("attribute"), F.concat(F.lit("kind "), F.col("kind"), F.lit(" takes no "), F.col("dep")))


def incompatible_providers(targets: DataFrame, roles: DataFrame) -> DataFrame:
    """Dependencies whose target gives none of the providers that the role (kind, role, accepts) takes."""
    bad = _dependencies_of_declared_roles(targets, roles).filter((F.size("accepts") > 0) & ~F.arrays_overlap("_given", "accepts"))
    return _found(bad, "incompatible_dependency_provider", F.col("attribute"), F.concat(F.col("dep"), F.lit(" gives none of "), F.array_join("accepts", ",")))


def unknown_roles(targets: DataFrame, roles: DataFrame) -> DataFrame:
    """Named roles of ``dependencies`` (map) that the kind doesn't declare, or that are called ``deps``."""
    named = targets.select("id", "kind", F.explode(F.map_keys("dependencies")).alias("role"))
    known = roles.filter("role <> 'deps'").select("kind", "role").distinct()
    lost = named.join(known, ["kind", "role"], "left_anti")
    return _found(lost, "unknown_dependency_role", F.concat(F.lit("dependencies."), F.col("role")), F.concat(F.lit("no role "), F.col("role")))


def visible_to(visibility: Column, package: Column, own_package: Column, dependent: Column) -> Column:
    """True if a rule lets a dependent (id, package) see a target of ``own_package``; no rule, or public, lets all."""

    def lets(rule: Column) -> Column:
        under = F.regexp_extract(rule, r"\Asubtree:(.*)\z", 1)
        return (
            (rule == "public") | ((rule == "private") & (package == own_package)) | (rule == F.concat(F.lit("package:"), package))
            | (rule.startswith("subtree:") & ((package == under) | package.startswith(F.concat(under, F.lit("/"))))) | (rule == dependent)
        )

    return (F.size(visibility) == 0) | F.exists(visibility, lets)


def invisible_dependencies(targets: DataFrame) -> DataFrame:
    """Dependencies on targets whose ``visibility`` doesn't let the dependent's package see them."""
    seen = targets.select(F.col("id").alias("dep"), F.col("package").alias("_p"), "visibility")
    bad = _named(targets).join(seen, "dep").filter(~visible_to(F.col("visibility"), F.col("package"), F.col("_p"), F.col("id")))
    return _found(bad, "dependency_not_visible", F.lit("deps"), F.concat(F.col("dep"), F.lit(" is not visible")))


def invalid_visibility(targets: DataFrame) -> DataFrame:
    """Rules that are neither public, private, a package, a subtree nor a reference to a target."""
    each = targets.select("id", "package", F.explode("visibility").alias("v"))
    prefix = F.regexp_extract("v", r"\A(package|subtree):", 1)
    folder = F.regexp_replace("v", r"\A(?:package|subtree):", "")
    plain = (folder != "") & ~folder.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)")
    target = relative_reference(F.col("package"), F.col("v")).isNotNull()
    good = F.col("v").isin("public", "private") | F.when(prefix != "", plain).otherwise(target)
    return _found(each.filter(~good), "invalid_visibility", F.lit("visibility"), F.col("v"))


def missing_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Declared sources (id, path), which may be patterns, that no file (path) is or matches."""
    owned = pattern_owners(files, sources.select(F.struct("id", "path").alias("id"), F.col("path").alias("pattern")))
    found = owned.select(F.col("id.id").alias("id"), F.col("id.path").alias("path")).distinct()
    lost = sources.select("id", "path").distinct().join(found, ["id", "path"], "left_anti")
    return _found(lost, "missing_source", F.lit("srcs"), F.concat(F.lit("no file "), F.col("path")))


def target_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """(id, package, name, ref): the references of attributes whose declared type is ``target``, those in select() branches too."""
    wanted = schema.filter("type = 'target'").select("kind", "name")
    each = targets.select("id", "package", "kind", "attrs").join(wanted, "kind")
    value = F.from_json("attrs", "map<string,string>")[F.col("name")]
    branches = F.map_values(F.from_json(F.get_json_object(value, "$.select"), "map<string,string>"))
    refs = F.when(is_select(value), branches).when(value.startswith("{") | value.startswith("["), F.array().cast("array<string>")).otherwise(F.array(value))
    each = each.select("id", "package", "name", F.explode(refs).alias("ref"))
    return each.filter(F.coalesce(F.col("ref") != "", F.lit(False)))


def invalid_target_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """References of target attributes that are malformed."""
    bad = target_attributes(targets, schema).filter(relative_reference(F.col("package"), F.col("ref")).isNull())
    return _found(bad, "invalid_target_attribute", F.col("name"), F.col("ref"))


def missing_target_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """References of target attributes to targets that don't exist."""
    refs = target_attributes(targets, schema).withColumn("ref", relative_reference(F.col("package"), F.col("ref"))).filter("ref IS NOT NULL")
    lost = refs.join(targets.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
    return _found(lost, "missing_target_attribute", F.col("name"), F.concat(F.lit("no target "), F.col("ref")))


def is_select(value: Column) -> Column:
    """True for a JSON text of an object whose only key is ``select`` and holds an object."""
    only = F.json_object_keys(value)
    return F.coalesce((F.size(only) == 1) & (F.get(only, F.lit(0)) == "select") & F.get_json_object(value, "$.select").startswith("{"), F.lit(False))


def _declared(targets: DataFrame, schema: DataFrame, *columns: str) -> DataFrame:
    """Attributes that their kind's schema lists, with columns of it."""
    return _attributes(targets).join(schema.select("kind", "name", *columns), ["kind", "name"])


def selects_not_allowed(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """select() values of attributes that the schema (kind, name, configurable, implemented) says are not configurable."""
    bad = _declared(targets, schema, "configurable", "implemented").filter(F.col("implemented") & ~F.col("configurable") & is_select(F.col("value")))
    return _found(bad, "select_on_non_configurable_attr", F.col("name"), F.lit("not configurable"))


def unimplemented_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """Attributes that the schema lists but that nothing implements."""
    bad = _declared(targets, schema, "implemented").filter(~F.col("implemented"))
    return _found(bad, "unimplemented_attr", F.col("name"), F.lit("not implemented"))


def dependency_cycles(edges: DataFrame) -> DataFrame:
    """One row for each group of targets that reach each other: (code, target: the least of them, attribute, message)."""
    groups = cycles(edges).groupBy("cycle").agg(F.min("node").alias("id"), F.count(F.lit(1)).alias("n"))
    return _found(groups, "dependency_cycle", F.lit("deps"), F.concat(F.col("n").cast("string"), F.lit(" targets depend on each other")))


def dependency_cycle_paths(edges: DataFrame) -> DataFrame:
    """One row for each group of targets that reach each other, as ``dependency_cycles``; the message is a shortest cycle: ``a -> b -> a``."""
    paths = cycle_paths(edges).withColumn("id", F.col("cycle"))
    way = F.concat(F.array_join(F.col("nodes").cast("array<string>"), " -> "), F.lit(" -> "), F.col("id").cast("string"))
    return _found(paths, "dependency_cycle", F.lit("deps"), F.concat(F.lit("dependency cycle: "), way))


def unknown_kinds(targets: DataFrame, kinds: DataFrame) -> DataFrame:
    lost = targets.join(kinds.select("kind").distinct(), "kind", "left_anti")
    return _found(lost, "unknown_target_kind", F.lit("kind"), F.concat(F.lit("no kind "), F.col("kind")))


def _attributes(targets: DataFrame) -> DataFrame:
    """(id, kind, name, value as JSON text) of all top-level attributes."""
    return targets.select("id", "kind", F.explode(F.from_json("attrs", "map<string,string>")).alias("name", "value"))


def unknown_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """Attributes that a kind's schema (kind, name, ...) doesn't list."""
    lost = _attributes(targets).join(schema.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    return _found(lost, "unknown_attr", F.col("name"), F.lit("not in the schema"))


def missing_attributes(targets: DataFrame, schema: DataFrame) -> DataFrame:
    wanted = targets.select("id", "kind").join(schema.filter("required").select("kind", "name"), "kind")
    lost = wanted.join(_attributes(targets).select("id", "name"), ["id", "name"], "left_anti")
    return _found(lost, "missing_required_attr", F.col("name"), F.lit("required"))


def disallowed_values(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """Values outside a non-empty ``allowed`` list, and values in ``disallowed``."""
    both = _attributes(targets).join(schema.select("kind", "name", "allowed", "disallowed"), ["kind", "name"])
    outside = both.filter((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")))
    inside = both.filter(F.array_contains("disallowed", F.trim("value")))
    return _found(outside, "attr_value_not_allowed", F.col("name"), F.col("value")).unionAll(_found(inside, "attr_value_disallowed", F.col("name"), F.col("value")))


def dependency_counts(targets: DataFrame, limits: DataFrame) -> DataFrame:
    """Targets with fewer or more dependencies than their kind's (kind, min_count, max_count)."""
    both = targets.select("id", "kind", F.size("deps").alias("n")).join(limits, "kind")
    bad = both.filter((F.col("n") < F.col("min_count")) | F.coalesce(F.col("n") > F.col("max_count"), F.lit(False)))
    return _found(bad, "dependency_count_mismatch", F.lit("deps"), F.concat(F.col("n").cast("string"), F.lit(" dependencies")))


def invalid_names(targets: DataFrame) -> DataFrame:
    """Targets without a name, with one that isn't a name, or without a kind."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    name, kind = F.col("name"), F.col("kind")
    bad = targets.filter(~blank(name) & ~name.rlike(NAME))
    return (
        _found(targets.filter(blank(name)), "target_name_required", F.lit("name"), F.lit("required"))
        .unionAll(_found(bad, "invalid_target_name", F.lit("name"), name))
        .unionAll(_found(targets.filter(blank(kind)), "target_kind_required", F.lit("kind"), F.lit("required")))
    )


def well_named(targets: DataFrame) -> DataFrame:
    """The targets that ``invalid_names`` finds nothing in. The other rules look at these only: a row without a name or kind has no other finding."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return targets.filter(~blank("name") & ~blank("kind") & F.col("name").rlike(NAME))


#: Fixed values of the enumerations in stored records.
ENUMS = {"evidence_status": ("passed", "failed"), "cache": ("hit", "miss", "bypass"), "attempt_status": ("passed", "failed", "error")}


def unknown_values(rows: DataFrame, column: str, enum: str, id_col: str = "id") -> DataFrame:
    """Records whose value isn't one of an enumeration's."""
    bad = rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[enum]))
    return _found(bad, f"unknown_{column}", F.lit(column), F.col(column), target=id_col)


def fingerprint_mismatches(evidence: DataFrame) -> DataFrame:
    """Evidence (id, input_digest, fingerprint_digest) whose fingerprint isn't of the inputs recorded, or that has no input digest."""
    bad = evidence.filter(F.col("fingerprint_digest").isNotNull() & ~F.col("fingerprint_digest").eqNullSafe(F.col("input_digest")))
    return _found(bad, "fingerprint_mismatch", F.lit("input_digest"), F.coalesce("input_digest", F.lit("missing")))


def _accepts(declared: str, value: object) -> bool:
    """True if a JSON value has a declared type; whole numbers are no floats."""
    if declared.startswith("list<"):
        return isinstance(value, list) and all(_accepts(declared[5:-1], v) for v in value)
    if declared.startswith("map<string,"):
        return isinstance(value, dict) and all(_accepts(declared[11:-1].strip(), v) for v in value.values())
    if declared in ("string", "target"):
        return isinstance(value, str)
    if declared == "bool":
        return isinstance(value, bool)
    if declared in ("int", "integer"):
        return isinstance(value, int) and not isinstance(value, bool)
    return declared == "float" and isinstance(value, float)


def type_mismatches(targets: DataFrame, schema: DataFrame) -> DataFrame:
    """Attributes whose JSON value, or a select() branch of it, hasn't the declared type.

    Types nest, so values are parsed in Arrow batches, once a target.
    """
    types = schema.groupBy("kind").agg(F.collect_list(F.struct("name", "type")).alias("types"))
    rows = targets.select("id", "attrs", "kind").join(types, "kind").select("id", "attrs", "types")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for i, attrs, types in zip(*(b.column(c).to_pylist() for c in ("id", "attrs", "types")), strict=True):
                values = json.loads(attrs or "{}")
                for t in types:
                    if t["name"] not in values:
                        continue
                    value = values[t["name"]]
                    select = isinstance(value, dict) and list(value) == ["select"] and isinstance(value["select"], dict)
                    if not all(_accepts(t["type"], v) for v in (value["select"].values() if select else [value])):
                        for o, x in zip(out, (i, t["name"], t["type"]), strict=True):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in out], names=["id", "name", "type"])

    bad = map_batches(rows, check, "id string, name string, type string")
    return _found(bad, "attr_type_mismatch", F.col("name"), F.concat(F.lit("not "), F.col("type")))


def diagnostics(*rules: DataFrame) -> DataFrame:
    """All findings, each once, by target, attribute, code and message; rows without a target first."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    order = [F.col(c).asc_nulls_first() for c in ("target", "attribute", "code", "message")]
    return out.distinct().orderBy(*order)

"""The property graph of targets, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _named(targets: DataFrame, column: str) -> Column:
    """Names in a column of texts, or of structs with a name."""
    element = targets.schema[column].dataType.elementType
    return F.transform(column, lambda c: c["name"]) if isinstance(element, T.StructType) else F.col(column)


def _or_empty(targets: DataFrame, column: str, kind: str) -> Column:
    empty = F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)
    return F.coalesce(F.col(column), empty) if column in targets.columns else empty


def properties(targets: DataFrame) -> Column:
    """All of a target's properties as a JSON object by name; what the table has no column for is empty."""
    texts = "array<string>"
    fields = {
        "capabilities": _named(targets, "capabilities"), "dependency_edges": _or_empty(targets, "dependencies", f"map<string,{texts}>"), "deps": F.col("deps"),
        "id": F.col("id"), "kind": F.col("kind"), "name": F.col("name"), "package": F.col("package"), "providers": F.col("providers"),
        "srcs": _or_empty(targets, "srcs", texts), "visibility": _or_empty(targets, "visibility", texts),
    }
    rest = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    # attributes are JSON already, and keep their numbers as written
    return F.concat(F.lit('{"attrs":'), F.coalesce("attrs", F.lit("{}")), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))


def nodes(targets: DataFrame) -> DataFrame:
    """(id, label, name, kind, package, props): targets, then their capabilities and providers.

    ``targets``: id, package, name, kind, deps, providers, capabilities (names, or structs of
    name, output_groups and requires_outputs), attrs (JSON); if there are such columns also
    srcs, visibility and dependencies (a map of role to ids).
    """
    none = F.lit(None).cast("string")
    own = targets.select("id", F.lit("Target").alias("label"), "name", "kind", "package", properties(targets).alias("props"))

    def part(column: str, label: str, more: list[str]) -> DataFrame:
        each = targets.select(F.col("id").alias("_t"), F.explode(column).alias("_p"))
        full = isinstance(each.schema["_p"].dataType, T.StructType)
        name = F.col("_p.name") if full else F.col("_p")
        given = each.schema["_p"].dataType.names if full else []
        none_of = F.array().cast("array<string>")
        lists = [(F.coalesce(F.col(f"_p.{m}"), none_of) if m in given else none_of).alias(m) for m in more]
        return each.select(
            F.concat_ws("#", "_t", F.lit(label.lower()), name).alias("id"), F.lit(label).alias("label"), name.alias("name"), none.alias("kind"), none.alias("package"),
            F.to_json(F.struct(name.alias("name"), *lists, F.col("_t").alias("target"))).alias("props"),
        )

    return own.unionAll(part("capabilities", "Capability", ["output_groups", "requires_outputs"])).unionAll(part("providers", "Provider", []))


def dependencies(targets: DataFrame) -> DataFrame:
    """(src, role, dst) of every dependency that is named: ``deps``, and by role where there is a map ``dependencies``."""
    plain = targets.select(F.col("id").alias("src"), F.lit("deps").alias("role"), F.explode("deps").alias("dst"))
    if "dependencies" not in targets.columns:
        return plain
    roles = targets.select(F.col("id").alias("src"), F.explode("dependencies").alias("role", "_deps"))
    return plain.unionAll(roles.select("src", "role", F.explode("_deps").alias("dst")))


def depends_on(targets: DataFrame) -> DataFrame:
    """(src, dst, type) of dependencies, by role too, on targets that exist; one row for each time one is named."""
    named = dependencies(targets).select("src", "dst")
    return named.join(targets.select(F.col("id").alias("dst")), "dst").select("src", "dst", F.lit("DEPENDS_ON").alias("type"))


def edges(targets: DataFrame) -> DataFrame:
    """(src, dst, type) of all kinds: DEPENDS_ON, EXPOSES, EMITS."""

    def part(column: str, label: str, kind: str) -> DataFrame:
        each = targets.select(F.col("id").alias("src"), F.explode(_named(targets, column)).alias("_n"))
        return each.select("src", F.concat_ws("#", "src", F.lit(label), "_n").alias("dst"), F.lit(kind).alias("type"))

    return depends_on(targets).unionAll(part("capabilities", "capability", "EXPOSES")).unionAll(part("providers", "provider", "EMITS"))


def of_kind(targets: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, package, name, kind, n_deps, capabilities as text) of the targets of a kind, or of all."""
    rows = targets.filter(F.col("kind") == kind) if kind else targets
    return rows.select("id", "package", "name", "kind", F.size("deps").cast("long").alias("n_deps"), F.array_join("capabilities", ",").alias("capabilities"))


def with_capability(targets: DataFrame, name: str) -> DataFrame:
    """Ids of the targets that have a capability."""
    return targets.filter(F.exists("capabilities", lambda c: c == name)).select("id")


def lookup(targets: DataFrame, target_id: str) -> DataFrame:
    """The target of an id; raises LookupError if there is none."""
    found = targets.filter(F.col("id") == target_id)
    if found.isEmpty():
        raise LookupError(f"no target {target_id}")
    return found


def capabilities_of(targets: DataFrame, target_id: str) -> DataFrame:
    """(capability): those of one target; raises LookupError if there is no such target."""
    return lookup(targets, target_id).select(F.explode("capabilities").alias("capability"))


def packages(targets: DataFrame) -> DataFrame:
    """(package): the distinct packages in order."""
    return targets.select("package").distinct().orderBy("package")


def workspace_summary(targets: DataFrame) -> DataFrame:
    """One row: targets, packages, and whether there are none."""
    return targets.agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count_distinct("package").alias("n_packages"),
        (F.count(F.lit(1)) == 0).alias("is_empty"),
    )

"""Read-only pattern queries over a property graph, built from DataFrame operations.

A graph is ``nodes`` (id, label, name, kind, package, and props: all properties as a JSON
object) and ``edges`` (src, dst, type). A pattern binds one alias to a node, or two by an edge
in either direction, or by any number of steps; conditions and results name
``alias.path.to.property``.

Conditions compare with texts, whole numbers, fractions, booleans, null and lists of these, by
kind and value. They are two-valued: a missing property equals nothing, not even null, and
differs from everything; a condition on an unknown alias is false, a result of one is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import closure


@dataclass(frozen=True)
class Condition:
    """``alias.path op value``; op is one of =, <>, contains, in, starts, ends."""

    alias: str
    path: str
    op: str
    value: object

    def column(self, aliases: set[str]) -> Column:
        if self.alias not in aliases:
            return F.lit(False)
        return F.coalesce(self._holds(), F.lit(False))

    def _holds(self) -> Column:
        no, value, text = F.lit(False), self.value, isinstance(self.value, str)
        if self.op in ("=", "<>"):
            same = F.coalesce(self._equals(value), no)
            return same if self.op == "=" else ~same
        if self.op == "in":
            return reduce(or_, [F.coalesce(self._equals(v), no) for v in value], no) if isinstance(value, (list, tuple, set)) else no
        plain = _plain(self.alias, self.path)
        got = None if plain is not None else _variant(self.alias, self.path)
        string = plain if plain is not None else F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(got, "$", "string"))
        if self.op == "contains":
            within = string.contains(value) if text else no
            if got is None:
                return within
            member = F.exists(F.try_variant_get(got, "$", "array<variant>"), lambda v: F.coalesce(_same(v, value), no))
            return F.when(F.schema_of_variant(got).startswith("ARRAY"), member).otherwise(within)
        test = {"starts": string.startswith, "ends": string.endswith}[self.op]
        return test(value) if text else no

    def _equals(self, value: object) -> Column:
        plain = _plain(self.alias, self.path)
        if plain is not None:
            return plain == value if isinstance(value, str) else F.lit(False)
        return _same(_variant(self.alias, self.path), value)


def _same(got: Column, value: object) -> Column:
    """Whether a JSON value is of a literal's kind and equal to it; an integer equals no fraction, lists go place by place."""
    kind = F.schema_of_variant(got)
    if value is None:
        return F.is_variant_null(got)
    if isinstance(value, (list, tuple)):
        parts = F.try_variant_get(got, "$", "array<variant>")
        equal = [F.coalesce(_same(F.get(parts, F.lit(i)), v), F.lit(False)) for i, v in enumerate(value)]
        return kind.startswith("ARRAY") & reduce(and_, equal, F.size(parts) == len(value))
    for python, json_kind, spark_type in ((bool, "BOOLEAN", "boolean"), (int, "BIGINT", "long"), (str, "STRING", "string")):
        if isinstance(value, python):
            return (kind == json_kind) & (F.try_variant_get(got, "$", spark_type) == F.lit(value))
    if isinstance(value, float):
        return (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(got, "$", "double") == F.lit(value))
    raise TypeError(f"no literal: {value!r}")


#: Properties that nodes have as columns, too.
_COLUMNS = ("id", "name", "kind", "package")
#: Nodes that are part of a target: their id is the library's own and no property.
PARTS = ("Capability", "Provider")


def _plain(alias: str, path: str) -> Column | None:
    """A property that is a column."""
    if path == "id":
        return F.when(~F.col(f"{alias}.label").isin(*PARTS), F.col(f"{alias}.id"))
    return F.col(f"{alias}.{path}") if path in _COLUMNS else None


def _path(path: str) -> str:
    return "$" + "".join(f"['{p.strip()}']" for p in path.split("."))


def _variant(alias: str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(f"{alias}.props"), _path(path), "variant")


def _property(alias: str, path: str) -> Column:
    """A property as text; objects and arrays as JSON. Paths go through objects only."""
    plain = _plain(alias, path)
    return plain if plain is not None else F.get_json_object(f"{alias}.props", _path(path))


@dataclass(frozen=True)
class Pattern:
    """Bound rows: one struct column an alias."""

    rows: DataFrame
    aliases: frozenset[str] = field(default_factory=frozenset)

    def where(self, *groups: list[Condition]) -> Pattern:
        """Keeps rows for which all conditions of one of the groups hold; without groups, all rows."""
        if not groups:
            return self
        either = [reduce(and_, [c.column(set(self.aliases)) for c in g], F.lit(True)) for g in groups]
        return Pattern(self.rows.filter(reduce(or_, either)), self.aliases)

    def returns(self, *plain: str, **results: str) -> DataFrame:
        """One column for each result: ``alias`` (all its properties as JSON) or ``alias.path`` (null if missing).

        A result given without a name is named by its own text.
        """
        columns = []
        for name, what in [*((w, w) for w in plain), *results.items()]:
            alias, _, path = what.partition(".")
            if alias not in self.aliases:
                value = F.lit(None).cast("string")
            elif path:
                value = _property(alias, path)
            else:
                value = F.col(f"{alias}.props")
            columns.append(value.alias(name))
        return self.rows.select(*columns)


def _as(nodes: DataFrame, alias: str, label: str | None, props: dict[str, object]) -> DataFrame:
    rows = nodes.filter(F.lower("label") == label.lower()) if label else nodes
    rows = rows.select(F.struct("id", "label", "name", "kind", "package", "props").alias(alias))
    for key, value in props.items():
        rows = rows.filter(Condition(alias, key, "=", value).column({alias}))
    return rows


def node(nodes: DataFrame, alias: str, label: str | None = None, **props: object) -> Pattern:
    """Nodes with a label (in any case) and equal top-level properties."""
    return Pattern(_as(nodes, alias, label, props), frozenset([alias]))


def related(
    nodes: DataFrame, edges: DataFrame, left: Pattern, edge_type: str, right: Pattern, reverse: bool = False, any_depth: bool = False
) -> Pattern:
    """Pairs of bound nodes joined by an edge type.

    One step keeps duplicate edges (a bag); any depth gives each reached node once and never
    the start. Closures start from the left side's nodes only.
    """
    (a,), (b,) = left.aliases, right.aliases
    typed = edges.filter(F.col("type") == edge_type)
    if reverse:
        typed = typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    if any_depth:
        starts = left.rows.select(F.col(f"{a}.id").alias("start"))
        typed = closure(typed, starts).select(F.col("start").alias("src"), F.col("node").alias("dst"))
    pairs = left.rows.join(typed, F.col(f"{a}.id") == typed["src"]).join(right.rows, F.col("dst") == F.col(f"{b}.id"))
    return Pattern(pairs.select(a, b), frozenset([a, b]))

"""Resolvers: table functions that expand a target into further ones, joined laterally and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from graphloom.functions.paths import relative_reference, target_id
from graphloom.sources.tables import Rounds, known_to_workers, stored

#: What a resolver yields: ``item`` is target (value: JSON of kind, deps, srcs, attrs), root (a
#: name, value null) or attr (value: its JSON). Without roots, all targets it yields are roots.
YIELDS = "item string, name string, value string"
#: Fixed value: how many targets a workspace may have.
MOST = 100_000
TARGET = "id string, package string, name string, kind string, deps array<string>, srcs array<string>, attrs string, owner string"


def register(spark: SparkSession, name: str, resolver: type) -> None:
    """Registers a class with ``eval(id, package, name, attrs)`` that yields rows of ``YIELDS`` as a table function of the session.

    ValueError if the session knows a function of that name.
    """
    if spark.catalog.functionExists(name):
        raise ValueError(f"a function {name} is registered already")
    known_to_workers(spark)
    spark.udtf.register(name, udtf(resolver, returnType=YIELDS))


def _fail(rows: DataFrame, columns: list[str], what: str) -> None:
    bad = rows.select(*columns).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def resolved(targets: DataFrame, resolvers: dict[str, str], most: int = MOST) -> DataFrame:
    """(id, package, name, kind, deps, srcs, attrs, owner): ``targets`` (without owner) and all that their kinds' resolvers make of them.

    ``resolvers``: kind to the name of a registered table function. What a resolver yields may
    have a resolver itself. The roots of what it yields become dependencies of the owner, the
    attributes it yields join the owner's. ValueError if an id comes twice, an attribute is
    declared already, or there would be more than ``most`` targets.
    """
    spark = targets.sparkSession
    done = Rounds(spark, "resolved")
    new = stored(targets.select("id", "package", "name", "kind", "deps", "srcs", "attrs", F.lit(None).cast("string").alias("owner")), "targets")
    n = new.count()
    while True:
        mine = new.filter(F.col("kind").isin(*resolvers)) if resolvers else new.limit(0)
        parts = []
        for kind, function in resolvers.items():
            mine.filter(F.col("kind") == kind).createOrReplaceTempView("graphloom_owners")
            parts.append(spark.sql(f"SELECT o.id AS owner, o.package AS package, r.item, r.name, r.value FROM graphloom_owners o, LATERAL {function}(o.id, o.package, o.name, o.attrs) r"))
        if not parts or mine.isEmpty():
            done.add(new)
            break
        items = parts[0]
        for p in parts[1:]:
            items = items.unionAll(p)
        items = stored(items, "items")
        spec = F.from_json("value", "kind string, deps array<string>, srcs array<string>")
        strings = F.array().cast("array<string>")
        at = target_id(F.col("package"), F.col("name"))
        made = items.filter("item = 'target'").select(
            at.alias("id"), "package", "name", spec["kind"].alias("kind"), F.coalesce(spec["deps"], strings).alias("deps"), F.coalesce(spec["srcs"], strings).alias("srcs"),
            F.coalesce(F.get_json_object("value", "$.attrs"), F.lit("{}")).alias("attrs"), "owner",
        )
        made = stored(made, "made")
        n += made.count()
        if n > most:
            raise ValueError(f"more than {most} targets")
        done.add(_merged(new, items, made))
        _fail(done.all().select("id", "owner").unionAll(made.select("id", "owner")).groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("owner").alias("owner")).filter("_n > 1 AND owner IS NOT NULL"), ["owner", "id"], "emitted twice")
        new = made
    return done.all()


def _merged(owners: DataFrame, items: DataFrame, made: DataFrame) -> DataFrame:
    """``owners`` with the roots among their dependencies and with the attributes that resolvers gave them."""
    own_names = made.select("owner", "name", F.col("id").alias("_id"))
    asked = items.filter("item = 'root'").select("owner", "package", "name")
    named = asked.join(own_names, ["owner", "name"], "left").select("owner", "name", F.coalesce("_id", relative_reference(F.col("package"), F.col("name"))).alias("dep"))
    _fail(named.filter("dep IS NULL"), ["owner", "name"], "no root")
    named = named.select("owner", "dep")
    silent = made.join(asked.select("owner"), "owner", "left_anti").select("owner", F.col("id").alias("dep"))
    roots = named.unionAll(silent).groupBy("owner").agg(F.sort_array(F.collect_set("dep")).alias("_roots"))
    given = items.filter("item = 'attr'").select(F.col("owner").alias("id"), "name", "value")
    declared = owners.select("id", F.explode(F.json_object_keys("attrs")).alias("name"))
    _fail(given.join(declared, ["id", "name"], "left_semi"), ["id", "name"], "declared by its owner")
    _fail(given.groupBy("id", "name").count().filter("count > 1"), ["id", "name"], "given twice")
    text = F.concat(F.to_json(F.struct(F.col("name").alias("k"))), F.lit("\0"), "value")
    pair = F.concat(F.regexp_extract(text, r"(?s)\A\{\"k\":(.*)\}\x00", 1), F.lit(":"), F.regexp_extract(text, r"(?s)\x00(.*)\z", 1))
    more = given.select("id", pair.alias("_p")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("_p")), ",").alias("_more"))
    both = owners.join(roots.withColumnRenamed("owner", "id"), "id", "left").join(more, "id", "left")
    added = F.array_except(F.coalesce("_roots", F.array().cast("array<string>")), "deps")
    body = F.regexp_replace(F.coalesce("attrs", F.lit("{}")), r"\s*\}\s*\z", "")
    attrs = F.when(F.col("_more").isNull(), F.col("attrs")).otherwise(F.concat(body, F.when(body.rlike(r"\A\s*\{\s*\z"), F.lit("")).otherwise(F.lit(",")), "_more", F.lit("}")))
    return both.select("id", "package", "name", "kind", F.concat("deps", added).alias("deps"), "srcs", attrs.alias("attrs"), "owner")

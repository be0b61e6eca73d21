"""Connected components of links by alternating stars, each round written to the shared folder.

Nodes can be named so that names sort as the ids of what they stand for (``named``). The
least name of a component then says its least id (``id_of``), with no join by component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialise

_SHIFT = 1 << 63


def named(ident: Column, kind: T.DataType, digest: Column) -> Column:
    """A text that sorts as ``ident`` (a whole number or a text; nulls last), then as ``digest``."""
    if isinstance(kind, T.IntegralType):
        text = F.lpad((ident.cast("decimal(20,0)") + F.lit(str(_SHIFT)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    else:
        text = F.concat(ident.cast("string"), F.lit("\0"))
    return F.concat(F.coalesce(F.concat(F.lit("i"), text), F.lit("n")), digest)


def id_of(name: Column, kind: T.DataType, digest_chars: int) -> Column:
    """The id in a name that ``named`` gave, with a digest of so many characters."""
    text = F.substring(name, F.lit(2), F.length(name) - 1 - digest_chars)
    if isinstance(kind, T.IntegralType):
        text = (text.cast("decimal(20,0)") - F.lit(str(_SHIFT)).cast("decimal(20,0)")).cast(kind)
    else:
        text = F.substring(text, F.lit(1), F.length(text) - 1).cast(kind)
    return F.when(name.startswith("i"), text)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    others = edges.join(least, "u").filter("v > _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return others.unionAll(least.select("u", F.col("_m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); a component is named by its least node.

    Links may repeat and go either way; self-links and links with a null end are left out.
    The rounds grow with the logarithm of the longest chain.
    """
    name = "links"
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialise(edges.distinct(), name)
    while True:
        roots = edges.select(F.col("v").alias("u")).distinct()
        chained = edges.join(roots, "u", "left_semi").limit(1).count()
        many = chained or edges.groupBy("u").count().filter("count > 1").limit(1).count()
        if not many:
            break
        edges = materialise(_small_star(_large_star(edges).distinct()), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

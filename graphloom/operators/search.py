"""Text search over a catalog of kinds, and lookups in it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import tokens

#: Words that say nothing of a kind next to the name of a family.
GENERIC = (
    "app", "application", "binary", "build", "existing", "executable", "kind", "kinds", "libraries", "library", "mixed", "native",
    "repository", "runner", "runners", "target", "targets", "test", "tests", "typed",
)

#: Fields of the entries of a kind's examples and references (arrays of structs) that are searched.
SEARCHED = {"examples": ("slug", "name", "use_when"), "references": ("system", "symbol", "use_when")}


def query_terms(text: str) -> list[str]:
    """Lower-case runs of letters and digits of a query, without repeats."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text).lower().split()))


def _mentions(columns: list[Column], terms: list[str]) -> Column:
    """True if a word of the columns holds one of the terms."""
    words = tokens(F.concat_ws(" ", *columns))
    return F.exists(words, lambda w: reduce(or_, [w.contains(t) for t in terms], F.lit(False)))


def searched_columns(catalog: DataFrame) -> list[Column]:
    """Texts in which words are looked for: name and docs, and what examples and references are and are for, where the catalog has them."""
    texts = [F.col("kind"), F.col("docs")]
    for column, fields in SEARCHED.items():
        if column in catalog.columns:
            has = catalog.schema[column].dataType.elementType.fieldNames()
            texts += [F.array_join(F.col(f"{column}.{f}"), " ") for f in fields if f in has]
    return texts


def matching(catalog: DataFrame, text: str, searched: tuple[str, ...] | None = None) -> DataFrame:
    """Catalog rows that a query asks for. ``searched``: the columns whose words count, else ``searched_columns``.

    A kind is ``family_segment...``. If exactly one term is a family, that family; if several
    are, those families and kinds that mention another term which isn't generic; else kinds
    with a segment equal to the first term that is one; else kinds that mention any term.
    Families and segments among the terms are found in one pass.
    """
    terms = query_terms(text)
    if not terms:
        return catalog
    texts = searched_columns(catalog) if searched is None else [F.col(c) for c in searched]
    parts = F.split("kind", "_")
    family = F.get(parts, F.lit(0))
    flags = [F.bool_or(family == t) for t in terms] + [F.bool_or(F.array_contains(parts, t)) for t in terms]
    known = catalog.agg(*[f.alias(str(i)) for i, f in enumerate(flags)]).first()
    families = [t for t, hit in zip(terms, known[: len(terms)], strict=True) if hit]
    segments = [t for t, hit in zip(terms, known[len(terms) :], strict=True) if hit]
    if len(families) == 1:
        return catalog.filter(family == families[0])
    if families:
        others = [t for t in terms if t not in families and t not in GENERIC]
        return catalog.filter(family.isin(*families) | _mentions(texts, others))
    if segments:
        return catalog.filter(F.array_contains(parts, segments[0]))
    return catalog.filter(_mentions(texts, terms))


def summaries(catalog: DataFrame) -> DataFrame:
    """(kind, docs, examples): of each kind its name, docs and the slugs of its examples (array of structs)."""
    return catalog.select("kind", "docs", F.col("examples.slug").alias("examples"))


def schema_of(catalog: DataFrame, kind: str) -> DataFrame:
    """The row of a kind; raises LookupError if there is none."""
    found = catalog.filter(F.col("kind") == kind)
    if found.isEmpty():
        raise LookupError(f"no kind {kind}")
    return found


def example_of(catalog: DataFrame, kind: str, slug: str) -> DataFrame:
    """The columns of one example of a kind; raises LookupError if there is no such kind or example."""
    found = schema_of(catalog, kind).select(F.inline("examples")).filter(F.col("slug") == slug)
    if found.isEmpty():
        raise LookupError(f"kind {kind} has no example {slug}")
    return found

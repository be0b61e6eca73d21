"""Event and log queries: filters, text cursors, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import cursor

DEFAULT_LIMIT = 200


def records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, source, order, message) with line numbers from 0 in each source, cursor and level."""
    w = Window.partitionBy(*keys, "source").orderBy("order", "message")
    numbered = lines.withColumn("line", (F.row_number().over(w) - 1).cast("long"))
    level = F.when(F.col("source") == "stderr", "error").otherwise("info")
    return numbered.select(*keys, cursor(F.col("source"), F.col("line")).alias("cursor"), "source", level.alias("level"), "message")


def matching_logs(logs: DataFrame, source: str | None = None, levels: list[str] | None = None, text: str | None = None, after: str | None = None) -> DataFrame:
    """Logs of a source, of given levels, holding a text, after a cursor (compared as text)."""
    if source is not None:
        logs = logs.filter(F.col("source") == source)
    if levels is not None:
        logs = logs.filter(F.col("level").isin(*levels))
    if text is not None:
        logs = logs.filter(F.coalesce("message", F.lit("")).contains(text))
    return logs if after is None else logs.filter(F.col("cursor") > after)


def matching_events(events: DataFrame, domain: str | None = None, kind: str | None = None, after: str | None = None) -> DataFrame:
    """Events of a domain and kind, after a cursor; an event without a cursor passes the cursor."""
    if domain is not None:
        events = events.filter(F.col("domain") == domain)
    if kind is not None:
        events = events.filter(F.col("kind") == kind)
    return events if after is None else events.filter(F.col("cursor").isNull() | (F.col("cursor") > after))


def first_events(events: DataFrame, order: list[str], limit: int = DEFAULT_LIMIT, at_least_one: bool = True) -> DataFrame:
    """The first rows in order. Event and supervisor queries give one row for a limit of 0, log queries none."""
    return events.orderBy(*order).limit(max(limit, 1) if at_least_one else limit)


def describe(sessions: DataFrame, session: str) -> DataFrame:
    """The document (session, document) of one session; LookupError if there is none, ValueError if it is no JSON object."""
    found = sessions.filter(F.col("session") == session)
    state = found.select(F.coalesce(F.get_json_object("document", "$").startswith("{"), F.lit(False)).alias("ok")).limit(1).collect()
    if not state:
        raise LookupError(f"no session {session}")
    if not state[0]["ok"]:
        raise ValueError(f"the description of session {session} is no JSON object")
    return found

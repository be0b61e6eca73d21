"""Columns over sizes, states, digests, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS = {"": 1, "b": 1}
for _i, _u in enumerate("kmgt", start=1):
    _POWERS |= {_u: 1024**_i, f"{_u}ib": 1024**_i, f"{_u}b": 1000**_i}
SEVERITIES = ("none", "note", "warning", "error")


def parse_size(text: Column) -> Column:
    """Bytes of ``10``, ``2GiB``, ``3kb``: one letter and ``iB`` are binary, ``kB`` decimal; null if malformed or more than a long holds."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"\A(\d+) *([a-z]*)\z", 1).try_cast("long")
    unit = F.regexp_extract(t, r"\A(\d+) *([a-z]*)\z", 2)
    times = F.create_map(*[F.lit(x) for pair in _POWERS.items() for x in pair])
    return F.try_multiply(number, F.element_at(times.cast("map<string,bigint>"), unit))


def status_of(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "passed").otherwise("failed")


def severity_of_level(level: Column) -> Column:
    """Severity of a report's level; unknown and missing ones are warnings."""
    return F.when(level.isin(*SEVERITIES), level).otherwise("warning")


def severity_rank(severity: Column) -> Column:
    """0 for none to 3 for error; null for other texts."""
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def is_digest(text: Column) -> Column:
    """True for 64 lower-case hex digits."""
    return F.coalesce(text.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def cursor(source: Column, line: Column) -> Column:
    """A log line's place as text that sorts within its source."""
    return F.format_string("%s:%012d", source, line)


def stable_id(domain: str, *parts: Column) -> Column:
    """Digest of a domain, a zero character and the parts as JSON."""
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), F.to_json(F.struct(*parts))), 256)


def length_prefixed(*parts: Column) -> Column:
    """Parts joined so that no other parts give the same text: each follows its length."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def first_branch(branches: Column, wanted: list[str]) -> Column:
    """The value of the first token of ``wanted`` that a map of branches has, else ``default``, else null."""
    return F.coalesce(*[F.element_at(branches, t) for t in [*wanted, "default"]])


#: Fixed names of processor families and systems.
_ARCH = {"aarch64": "arm64", "arm64": "arm64", "x86_64": "amd64", "amd64": "amd64", "x86": "386", "i386": "386", "i686": "386"}
_SYSTEM = {"darwin": "macos", "mac": "macos", "macosx": "macos"}


def _renamed(name: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name), name)


def arch(name: Column) -> Column:
    """One name for each processor family; others stay as they are."""
    return _renamed(name, _ARCH)


def operating_system(name: Column) -> Column:
    """One name for each system; others stay as they are."""
    return _renamed(name, _SYSTEM)


def platform_tokens(system: Column, machine: Column) -> Column:
    """What a platform is called in a map of branches, the most special first; unknown systems have no names."""
    of = lambda *names: F.array(*names)
    join = lambda tail: F.concat(system, F.lit(f"-{tail}"))
    known = system.isin("macos", "linux", "windows")
    return (
        F.when(~known, F.array().cast("array<string>"))
        .when(machine == "aarch64", of(join("arm64"), join("aarch64"), system, F.lit("arm64"), F.lit("aarch64")))
        .when(machine == "x86_64", of(join("x86_64"), system, F.lit("x86_64")))
        .otherwise(of(system))
    )


def json_pointer(text: Column, pointer: str) -> Column:
    """The value at a JSON pointer (``/a/0/b``): texts bare, others as JSON; null if there is none.

    A number may be a key or a place in a list.
    """
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if any(("'" in p or "?" in p or not p) and (not p or "." in p or "[" in p) for p in parts):
        found = F.try_parse_json(text)
        for p in parts:
            key = F.try_variant_get(found, '$["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]', "variant")
            found = F.coalesce(key, F.try_variant_get(found, f"$[{p}]", "variant")) if _is_place(p) else key
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")).otherwise(F.to_json(found))
    paths = ["$"]
    for p in parts:
        key = f".{p}" if "'" in p or "?" in p else f"['{p}']"
        paths = [q + step for q in paths for step in ([key, f"[{p}]"] if _is_place(p) else [key])]
    return F.coalesce(*[F.get_json_object(text, q) for q in paths])


def _is_place(part: str) -> bool:
    return part.isascii() and part.isdigit() and part == str(int(part))


def decoded_base64(text: Column) -> Column:
    """The bytes of a standard base64 text; null if malformed."""
    return F.try_to_binary(text, F.lit("base64"))


def first_distinct(values: Column) -> Column:
    """The distinct values of an array in order of their first place."""
    return F.array_distinct(values)


def shell_quote(text: Column) -> Column:
    """A text as one word of a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def powershell_quote(text: Column) -> Column:
    """A text as one word of PowerShell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def cut_bytes(text: Column, most: int) -> Column:
    """(text, truncated): the first ``most`` bytes as text; a cut character at the end goes."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    truncated = F.octet_length(text) > most
    return F.struct(F.when(truncated, F.regexp_replace(head, "\ufffd+\\z", "")).otherwise(text).alias("text"), truncated.alias("truncated"))


def workers(batches: Column, most: int) -> Column:
    """Workers for so many batches: at least 1, at most ``most``."""
    return F.greatest(F.lit(1), F.least(batches, F.lit(most)))


def worker_memory(limit: Column, n_workers: Column) -> Column:
    """Bytes for each worker: an equal share of the limit, at least 1; 0 means no limit."""
    return F.when(limit == 0, F.lit(0)).otherwise(F.greatest(F.floor(limit / F.greatest(n_workers, F.lit(1))), F.lit(1))).cast("long")


def parallel_actions(cpus: Column, memory: Column, memory_each: Column) -> Column:
    """Actions of the usual size that run at once: as many as processors and memory allow, at least 1."""
    fit = F.greatest(F.least(cpus, F.floor(memory / memory_each)), F.lit(1))
    return F.when((memory == 0) | (memory_each == 0), cpus).otherwise(fit).cast("long")


def human_row(*columns: Column) -> Column:
    """Values joined by `` | ``; null is written so."""
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])

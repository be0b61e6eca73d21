"""Columns over paths, patterns, ids and addresses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each mark of a pattern stands for. A star crosses slashes.
_GLOB = ((r"\*+", ".*"), (r"\?", "."))


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def usable_pattern(pattern: Column) -> Column:
    """False for absolute patterns and those that go up."""
    return ~pattern.startswith("/") & ~pattern.rlike(r"(?:\A|/)\.\.(?:/|\z)")


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a pattern of ``*``, ``?`` and ``[..]`` (``[!..]``: none of)."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    for mark, rx in _GLOB:
        out = F.regexp_replace(out, mark, rx)
    return F.concat(F.lit(r"\A"), F.replace(out, F.lit("[!"), F.lit("[^")), F.lit(r"\z"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """True if one of the given patterns matches."""
    return reduce(or_, [F.regexp_like(path, glob_regex(F.lit(p))) if any(c in p for c in "*?[") else path == p for p in patterns], F.lit(False))


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; an empty list of inclusions includes all."""
    return ~matches_any(path, exclude) & (matches_any(path, include) if include else F.lit(True))


def within(path: Column, directory: Column) -> Column:
    """True for the directory itself and all under it."""
    return (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def normalise_path(path: Column) -> Column:
    """Without leading ``./``, repeated or closing slashes; other oddities stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"\A(?:\./)+", ""), r"(?<=.)/\z", "")


def target_id(package: Column, name: Column) -> Column:
    """``package/name``, or the name at the root."""
    return F.concat_ws("/", F.nullif(package, F.lit("")), name)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_reference(package: Column, ref: Column) -> Column:
    """The id that a reference names from a package: ``./x``, ``../x`` or ``a/b``; null if malformed."""
    bad = ref.contains(":") | ref.contains("//") | ref.startswith("/") | (ref == "")
    ups = F.size(F.regexp_extract_all(F.regexp_extract(ref, r"\A((?:\.\./)+)", 1), F.lit(r"\.\./"), F.lit(0)))
    parts = F.filter(F.split(package, "/"), lambda p: p != "")
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    rest = F.regexp_replace(ref, r"\A(?:\.\./)+", "")
    relative = F.when(ups > F.size(parts), F.lit(None)).otherwise(target_id(up, rest))
    here = target_id(package, F.regexp_replace(ref, r"\A\./", ""))
    return F.when(bad, F.lit(None)).when(ref.startswith("../"), relative).when(ref.startswith("./"), here).otherwise(ref)


def safe_path(ident: Column) -> Column:
    """A target id as a path: null unless every part is of letters, digits, ``.``, ``_``, ``-`` and isn't ``.`` or ``..``."""
    good = ident.rlike(r"\A(?:(?!\.{1,2}(?:/|\z))[A-Za-z0-9._-]+)(?:/(?!\.{1,2}(?:/|\z))[A-Za-z0-9._-]+)*\z")
    return F.when(good, ident)


def has_extension(path: Column, endings: list[str]) -> Column:
    """True if a path ends in one of the given endings."""
    return reduce(or_, [path.endswith(e) for e in endings], F.lit(False))


def excluded_walk(path: Column, paths: list[str] = (), names: list[str] = ()) -> Column:
    """True for a path under one of ``paths``, or with one of ``names`` as a part at any depth."""
    parts = F.split(path, "/")
    return reduce(or_, [*(within(path, F.lit(p)) for p in paths), *(F.array_contains(parts, n) for n in names)], F.lit(False))


def file_uri_path(uri: Column) -> Column:
    """The path of a file URI, or of a plain path: slashes forward, percent codes decoded."""
    plain = F.replace(F.regexp_replace(uri, r"\Afile://(?:localhost)?/?", ""), F.lit("\\"), F.lit("/"))
    return F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def area(path: Column) -> Column:
    """The area a changed path belongs to; null for paths that aren't tracked."""
    return (
        F.when(within(path, F.lit(".git")), F.lit(None)).when(within(path, F.lit(".cache/out")), "output")
        .when(within(path, F.lit(".cache")), F.lit(None)).otherwise("source")
    )


def is_public_ipv4(address: Column) -> Column:
    """False for private, loopback, link-local, broadcast, documentation, multicast, unspecified and malformed addresses."""
    part = lambda i: F.regexp_extract(address, r"\A(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z", i).try_cast("int")
    a, b, c, d = (part(i) for i in (1, 2, 3, 4))
    bad = (
        a.isin(10, 127) | a.between(224, 239) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
        | ((a == 0) & (b == 0) & (c == 0) & (d == 0)) | ((a == 255) & (b == 255) & (c == 255) & (d == 255))
    )
    whole = a.between(0, 255) & b.between(0, 255) & c.between(0, 255) & d.between(0, 255)
    return F.coalesce(whole & ~bad, F.lit(False))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address as numbers; null if malformed."""

    def with_tail(tail: Column) -> Column:
        byte = lambda i: F.get(F.split(tail, r"\."), F.lit(i)).try_cast("int")
        two = F.concat_ws(":", F.hex(byte(0) * 256 + byte(1)), F.hex(byte(2) * 256 + byte(3)))
        return F.when(tail != "", F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), two)).otherwise(address)

    def listed(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        return F.concat(left, F.array_repeat(F.lit("0"), missing), right)

    def of_halves(halves: Column) -> Column:
        sides = F.array(listed(F.get(halves, F.lit(0))), listed(F.get(halves, F.lit(1))))
        return F.when(F.size(halves) == 1, F.get(sides, F.lit(0))).when(F.size(halves) == 2, _let(sides, filled))

    def numbers(parts: Column) -> Column:
        good = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike(r"\A[0-9A-Fa-f]{1,4}\z"))
        return F.when(good, F.transform(parts, lambda g: F.conv(g, 16, 10).cast("int")))

    tail = F.regexp_extract(address, r":(\d{1,3}(?:\.\d{1,3}){3})\z", 1)
    return _let(_let(_let(_let(tail, with_tail), lambda t: F.split(t, "::", -1)), of_halves), numbers)


def _is_public_ipv6(g: Column) -> Column:
    at = lambda i: F.get(g, F.lit(i))
    zeros = F.transform(F.array(F.lit(5), F.lit(7)), lambda n: F.forall(F.slice(g, F.lit(1), n), lambda x: x == 0))
    byte = lambda i, shift: F.shiftright(at(i), shift).bitwiseAND(255)
    inner = F.format_string("%d.%d.%d.%d", byte(6, 8), byte(6, 0), byte(7, 8), byte(7, 0))
    blocked = (
        (F.get(zeros, F.lit(1)) & at(7).isin(0, 1)) | (at(0) >= 0xFF00) | (at(0).bitwiseAND(0xFE00) == 0xFC00) | (at(0).bitwiseAND(0xFFC0) == 0xFE80)
        | ((at(0) == 0x2001) & (at(1) == 0x0DB8))
    )
    return F.when(F.get(zeros, F.lit(0)) & (at(5) == 0xFFFF), _let(inner, is_public_ipv4)).otherwise(~blocked)


def is_public_ip(address: Column) -> Column:
    """True for a public IPv4 or IPv6 address; an IPv4 address inside IPv6 counts as itself."""
    six = _let(_groups(address), _is_public_ipv6)
    return F.coalesce(F.when(address.contains(":"), six).otherwise(is_public_ipv4(address)), F.lit(False))


def is_public_url(url: Column) -> Column:
    """True for an https address whose host is neither local nor an address that isn't public."""
    host = F.lower(F.regexp_extract(url, r"\A[Hh][Tt][Tt][Pp][Ss]://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)(?::\d*)?(?:[/?#].*)?\z", 1))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    address = host.startswith("[") | host.rlike(r"\A[0-9.]+\z")
    local = (host == "localhost") | host.endswith(".localhost")
    return F.coalesce((host != "") & ~local & (~address | _let(bare, is_public_ip)), F.lit(False))

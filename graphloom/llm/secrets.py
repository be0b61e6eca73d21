"""Secret scans: pattern spans, and literals assigned to sensitive names.

The lexer finds assignments of source and configuration syntax: ``name = literal``,
``"name": 'literal'``, ``x["name"] = literal``, ``name[] = literal``, ``name: type = literal``,
``name: bareword``, ``name := a + b``, ``name += literal``, YAML blocks (``name: |``), and names
with a default in a call (``get("name", "literal")``). Literals may be quoted by one or three
quotes, by backquotes or as ``r#".."#``, with a prefix (``f"..{other}.."``), in parentheses, side by
side, and go on in the next line after ``+``, a backslash or inside parentheses. A value may have
alternatives: members of lists and tuples, ``a or "b"``, ``a ? b : "c"``, ``"a" if b else "c"``.
The lexer keeps the constants of the text, follows names through them, and scores the literals
that reach a name by how sensitive that name is and how random the literal looks. A name
stands for what it was last given before, else for what it is given first after; ``C.k`` for
``k`` where nothing has the whole name. A bareword that names no constant of the text is itself a
literal (``.env``, YAML, properties), unless it is called (``name(...)``), is part of an
expression, or is a dotted name without a digit.

Names, literals and constants have no greatest length or number. An assignment keeps its own
literals and links to the assignments it names; sensitivity runs along the links, each once. How
random a value looks is told by its length and its counts of characters, which add up under
concatenation, so nothing of a value is left out and the work grows with the text.

Defined cases: null text is empty and has no spans; an empty table gives an empty one; repeated
rows give repeated results; spans are code points, end exclusive, in order of start and then
kind; ``scan`` looks at its text column only and passes all columns on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, parts, read

KINDS = ("assign", "access", "hex", "lexed")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words of a name and how sensitive they make it.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "auth": 1.5, "authorization": 1.5, "bearer": 2.0, "signature": 1.0,
    "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "client": 0.5, "session": 1.0, "encryption": 1.5, "salt": 1.0,
}
#: Least sensitivity of a name, and least score of name and literal together.
MIN_NAME, MIN_SCORE = 2.0, 5.0
MIN_LITERAL = 8
#: Literals that stand for a secret given elsewhere.
PLACEHOLDER = re.compile(r"(?i)\A(?:\$\{.*|<.*>|\{\{.*|%\(.*|x{4,}|\*{4,}|your[-_ ].*|change[-_ ]?me.*|example.*|placeholder.*|none|null|true|false|undefined|redacted.*|process\.env.*|os\.environ.*)\Z")

#: The same for values longer than ``_SHORT``, by how they begin; ``<..>``, ``xxxx`` and ``****`` are told by their characters.
_PLACEHOLDER_START = re.compile(r"(?i)\$\{|\{\{|%\(|your[-_ ]|change[-_ ]?me|example|placeholder|redacted|process\.env|os\.environ")
_SHORT = 32

_OPERATOR = re.compile(r"\+=|:=|=>|[:=]")
#: A name before an operator, read backwards from it: plain, quoted, or a quoted subscript.
_NAME_BACKWARDS = re.compile(r"""[ \t]*(?:(?:\][A-Za-z0-9_]*\[[ \t]*)?([A-Za-z0-9_.-]*[A-Za-z_])|"([A-Za-z0-9_. -]*[A-Za-z_])"|'([A-Za-z0-9_. -]*[A-Za-z_])'|\]"([A-Za-z0-9_. -]*[A-Za-z_])"\[|\]'([A-Za-z0-9_. -]*[A-Za-z_])'\[)""")
#: A declared type between a name's colon and its ``=``.
_TYPE = re.compile(r"[ \t]*&?(?:'[a-z]+[ \t]+)?[A-Za-z_][\w.<>\[\], |?&*]*?[ \t]*=(?![=>])")
_PREFIX = re.compile(r"(?:[fFrRbBuU]{1,2}|[@$])(?=[\"'])")
_QUOTED = re.compile(r"""\"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`""", re.S)
_BARE = re.compile(r"[A-Za-z0-9_$+/.~@!%^&*=-]+")
#: What may stand before the first term, and between two, outside and inside parentheses.
_LEAD = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*(?=[fFrRbBuU]{0,2}[\"'`]))?")
_GAP = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?(?:\+(?!=)[ \t]*(?:\\?\r?\n[ \t]*)?)?(?=[fFrRbBuU]{0,2}[\"'`])|[ \t]*(?:\\?\r?\n[ \t]*)?\+(?![=+])[ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'`A-Za-z_])")
_GAP_INSIDE = re.compile(r"\s*(?:\+\s*)?(?=[\"'`A-Za-z_])")
#: References in a formatted string or a template.
_HOLE = re.compile(r"\$?\{([^{}]*)\}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Arguments right after a bareword, which make it a call.
_CALL = re.compile(r"\((?:[ \t]*\n|(?:[^()\n]|\([^()\n]*+\))*+\))")
_IDENTIFIER = re.compile("[A-Za-z_][A-Za-z0-9_.]*")
#: A bareword that is all there is of a value, and doesn't go on in the next line.
_SIMPLE = re.compile(r"[ \t]*([A-Za-z0-9_$+/.~@!%^&*=-]+)[ \t]*(?=\r?\n(?![ \t]*\+)|\Z)")
#: What may stand between alternatives; the last is one only after a question mark.
_OR = re.compile(r"[ \t]*(?:\bor\b|\|\||\?\?|\?:|(\?)|\bif\b[^\n]*?\belse\b|(:))[ \t]*(?=[fFrRbBuU]{0,2}[\"'`A-Za-z_])")
_RAW = re.compile(r"""b?r(#+)"(.*?)"\1""", re.S)
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[1-9]?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
_OPENERS = re.compile(r"[\[({]\s*")
#: Between members of lists: commas and brackets.
_MEMBER = re.compile(r"\s*[,\[\](){}][\s,\[\](){}]*")
_KEY = re.compile(r"[ \t]*(?::|=>)")
#: A name and its default in a call, and how the names of functions end that are called so.
_DEFAULT = re.compile(r"""\(\s*(?:"([A-Za-z0-9_. -]*[A-Za-z_])"|'([A-Za-z0-9_. -]*[A-Za-z_])')\s*,\s*""")
_WITH_DEFAULT = ("get", "env", "put", "default", "property")

#: A literal's place, and what it may be: "text", "bare" (a literal or a name), "name" or "call".
Term = tuple[int, int, str]


def sensitivity(name: str) -> float:
    """How sensitive a name is: the sum over its distinct words, singular or plural."""
    parts = {p.lower() for p in _PARTS.findall(name)}
    return sum(SENSITIVE.get(p) or SENSITIVE.get(p.removesuffix("s"), 0.0) for p in parts)


class Value:
    """What counts of a text for how random it looks; values add up as their texts would."""

    __slots__ = ("alpha", "counts", "head", "last", "length")

    def __init__(self, text: str = ""):
        self.length, self.counts, self.head, self.last, self.alpha = len(text), Counter(text), text[:_SHORT], text[-1:], not text or text.isalpha()

    def add(self, other: Value) -> None:
        self.head = (self.head + other.head)[:_SHORT] if self.length < _SHORT else self.head
        self.length += other.length
        self.counts.update(other.counts)
        self.last, self.alpha = other.last or self.last, self.alpha and other.alpha

    def entropy(self) -> float:
        """Bits per character of the text's own distribution of characters."""
        return -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values() if c * 10**300 > self.length) if self.length else 0.0

    def is_placeholder(self) -> bool:
        if "\n" in self.counts:
            return False
        if self.length <= _SHORT:
            return bool(PLACEHOLDER.match(self.head))
        only = self.counts.keys()
        return bool(_PLACEHOLDER_START.match(self.head)) or (self.head[0] == "<" and self.last == ">") or only <= {"x", "X"} or only == {"*"}

    def score(self) -> float:
        """0 for short literals, placeholders and plain words; more for long mixed ones."""
        if self.length < MIN_LITERAL or self.alpha or self.is_placeholder():
            return 0.0
        there = "".join(self.counts)
        classes = sum(bool(c.search(there)) for c in _CLASSES)
        return min(self.entropy(), 4.0) + 0.5 * (classes - 1) + (0.5 if self.length >= 20 else 0.0)


_CLASSES = tuple(re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def _quoted(text: str, at: int, closed: dict[str, int]) -> tuple[int, int, int] | None:
    """(start, end, after) of the contents of a quoted literal at ``at``.

    ``closed`` remembers for each three quotes from where on none follow, so no search is made twice.
    """
    if m := _RAW.match(text, at) if text[at : at + 1] in ("r", "b") else None:
        return *m.span(2), m.end()
    three = text[at : at + 3]
    if three in ('"""', "\'\'\'") and at < closed.get(three, len(text)):
        end = text.find(three, at + 3)
        if end >= 0:
            return at + 3, end, end + 3
        closed[three] = at
    if m := _QUOTED.match(text, at):
        return *m.span(m.lastindex), m.end()
    return None


def _terms(text: str, at: int, inside: bool, closed: dict[str, int]) -> tuple[list[Term], int, bool]:
    """The terms of one value at ``at``, where it ends, and if one is quoted."""
    found: list[Term] = []
    quoted = False
    while True:
        prefix = _PREFIX.match(text, at)
        if place := _quoted(text, prefix.end() if prefix else at, closed):
            start, end, after = place
            template = text[start - 1] == "`" or (prefix and prefix[0].lower().strip("rb@") in ("f", "$"))
            if template:
                for hole in _HOLE.finditer(text, start, end):
                    found.append((start, hole.start(), "text"))
                    if _IDENTIFIER.fullmatch(name := hole[1].strip()):
                        of = hole.start(1) + hole[1].index(name)
                        found.append((of, of + len(name), "name"))
                    start = hole.end()
            found.append((start, end, "text"))
            at, quoted = after, True
        elif bare := (_IDENTIFIER if inside or found else _BARE).match(text, at):
            kind = "text"
            if _IDENTIFIER.fullmatch(bare[0]):
                call = _CALL.match(text, bare.end())
                kind = "call" if call else "name" if inside else "bare"
            found.append((*bare.span(), kind))
            at = bare.end()
        else:
            break
        gap = (_GAP_INSIDE if inside else _GAP).match(text, at)
        if not gap or (found[-1][2] != "text" and "+" not in gap[0]) or (inside and _starts_or(text, at)):
            break
        at = gap.end()
    return found, at, quoted


def _starts_or(text: str, at: int) -> bool:
    m = _OR.match(text, at)
    return bool(m) and m[2] is None


def _names(terms: list[Term], alone: bool) -> list[Term]:
    """In an expression barewords are names."""
    return terms if alone and len(terms) <= 1 else [(a, b, "name" if kind == "bare" else kind) for a, b, kind in terms]


def _values(text: str, at: int, config: bool, indent: int, closed: dict[str, int]) -> tuple[list[list[Term]], int, bool]:
    """The alternatives of the value at ``at``, where it ends, and if one is quoted. ``config``: it can't start in the next line."""
    if config and (block := _BLOCK.match(text, at)):
        return _block(text, block.end(), indent)
    lead = _LEAD.match(text, at)
    at = at + len(lead[0]) - len(lead[0].lstrip(" \t")) if config and "\n" in lead[0] else lead.end()
    begin = at
    while m := _OPENERS.match(text, at):
        at = m.end()
    opened = text[begin:at]
    depth = sum(c in "[({" for c in opened)
    found: list[list[Term]] = []
    quoted, asked = False, False
    while True:
        terms, at, some = _terms(text, at, depth > 0, closed)
        if not terms or (not found and depth and opened.strip()[-1] != "(" and _KEY.match(text, at)):
            break  # nothing, or the first key of a map
        found.append(terms)
        quoted |= some
        if terms[-1][2] == "call" and (call := _CALL.match(text, at)):
            at = call.end()
        choice = _OR.match(text, at)
        if choice and (choice[2] is None or asked):
            asked |= choice[1] is not None
            at = choice.end()
        elif depth and (member := _MEMBER.match(text, at)):
            depth += sum((c in "[({") - (c in "])}") for c in member[0])
            if depth <= 0:
                break
            at = member.end()
        else:
            break
    return [_names(t, len(found) == 1) for t in found], at, quoted


def _block(text: str, at: int, indent: int) -> tuple[list[list[Term]], int, bool]:
    """The lines of a YAML block: those indented more than its key, and blank ones between them."""
    terms: list[Term] = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        inner = line.strip()
        if inner:
            start = at + line.index(inner)
            if start - at <= indent:
                break
            terms.append((start, start + len(inner), "text"))
        at = end + 1
    return ([terms] if terms else []), at, True


#: A statement: where it is, its name, the alternatives of its value, and if it adds to what the name was.
Statement = tuple[int, str, list[list[Term]], bool]


def statements(text: str) -> list[Statement]:
    """Assignments in order."""
    found: list[Statement] = []
    done = 0
    closed: dict[str, int] = {}
    backwards = None
    for op in _OPERATOR.finditer(text):
        begin = op.start()
        if begin < done or text[begin - 1 : begin] in ("=", "!", "<", ">", ":") or text[op.end() : op.end() + 1] == "=":
            continue
        sign = op[0]
        if sign == ":" and text.startswith("//", op.end()):
            continue
        if backwards is None:
            backwards = text[::-1]
        name = _NAME_BACKWARDS.match(backwards, len(text) - begin)
        if not name:
            continue
        said = name[name.lastindex][::-1].strip()
        if simple := _SIMPLE.match(text, op.end()):
            kind = "bare" if _IDENTIFIER.fullmatch(simple[1]) else "text"
            found.append((begin, said, [[(*simple.span(1), kind)]], sign == "+="))
            done = op.end()
            continue
        declared = _TYPE.match(text, op.end()) if sign == ":" else None
        start = declared.end() if declared else op.end()
        config = sign == ":" and not declared
        indent = 0
        if config:
            line = text.rfind("\n", 0, begin) + 1
            indent = len(text) - len(text[line:begin].lstrip(" -")) - (len(text) - begin) - line if text[line : line + 1] in (" ", "-") else 0
        values, at, quoted = _values(text, start, config, indent, closed)
        if values:
            found.append((begin, said, values, sign == "+="))
            done = at if quoted else start
    defaults = []
    for m in _DEFAULT.finditer(text):
        if not text[max(m.start() - 8, 0) : m.start()].lower().endswith(_WITH_DEFAULT):
            continue
        values, _, _ = _values(text, m.end(), True, 0, closed)
        if values:
            defaults.append((m.start(), m[m.lastindex], values, False))
    return sorted([*found, *defaults], key=lambda s: s[0]) if defaults else found


class _Links:
    """The assignments of a text: each alternative's own literals and parts, and which assignments names stand for."""

    def __init__(self, text: str):
        self.text = text
        self.given: dict[str, list[int]] = {}
        self.statements = statements(text)
        for i, (_, name, _, _) in enumerate(self.statements):
            self.given.setdefault(name, []).append(i)
        self.seen: dict[int, list[list[tuple[int, int] | int]]] = {}
        self.known: dict[int, Value] = {}

    def parts(self, at: int) -> list[list[tuple[int, int] | int]]:
        """The alternatives of an assignment, worked out when they are asked for."""
        found = self.seen.get(at)
        if found is None:
            found = self.seen[at] = self._resolved(at, *self.statements[at][1:])
        return found

    def _held(self, name: str, at: int) -> int | None:
        """The assignment that a name stands for at ``at``."""
        places = self.given.get(name)
        if not places:
            return None
        before = bisect_left(places, at)
        if before:
            return places[before - 1]
        after = bisect_right(places, at)
        return places[after] if after < len(places) else None

    def _resolved(self, at: int, name: str, alternatives: list[list[Term]], adds: bool) -> list[list[tuple[int, int] | int]]:
        """Each alternative as spans of literals and numbers of assignments, in order."""
        out = []
        for terms in alternatives:
            parts: list[tuple[int, int] | int] = []
            if adds and (held := self._held(name, at)) is not None and held < at:
                parts.append(held)
            for start, end, kind in terms:
                if kind == "text":
                    parts.append((start, end))
                    continue
                if kind == "call":
                    continue
                term = self.text[start:end]
                held = self._held(term, at)
                if held is not None:
                    parts.append(held)
                    continue
                if "." in term and (held := self._held(term.rpartition(".")[2], at)) is not None:
                    parts.append(held)
                if kind == "bare" and ("." not in term or any(c.isdigit() for c in term)):
                    parts.append((start, end))
            out.append(parts)
        return out

    def _summed(self, parts: list[tuple[int, int] | int]) -> Value:
        value = Value()
        for part in parts:
            if not isinstance(part, int):
                value.add(Value(self.text[part[0] : part[1]]))
            elif part in self.known:
                value.add(self.known[part])
        return value

    def alternatives(self, at: int) -> list[Value]:
        """The value of each alternative of an assignment. A name that stands for itself in a round adds nothing."""
        waiting, open_ = [p for parts in self.parts(at) for p in parts if isinstance(p, int)], set()
        while waiting:
            one = waiting[-1]
            if one in self.known:
                waiting.pop()
                continue
            needed = [p for parts in self.parts(one) for p in parts if isinstance(p, int) and p not in self.known]
            if one in open_ or not needed:
                self.known[one] = max((self._summed(parts) for parts in self.parts(one)), key=Value.score)
                waiting.pop()
            else:
                open_.add(one)
                waiting += [p for p in needed if p not in open_]
        return [self._summed(parts) for parts in self.parts(at)]


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of every literal that reaches a sensitive name."""
    links = _Links(text)
    best: dict[tuple[int, int], float] = {}
    reached: list[tuple[float, int]] = []
    weights = {name: sensitivity(name) for name in links.given}
    for at, (_, name, _, _) in enumerate(links.statements):
        weight = weights[name]
        if weight < MIN_NAME:
            continue
        for parts, value in zip(links.parts(at), links.alternatives(at), strict=True):
            random = value.score()
            if random > 0 and weight + random >= MIN_SCORE + (weight - MIN_NAME) * 0.5:
                for part in parts:
                    if isinstance(part, int):
                        reached.append((weight + random, part))
                    else:
                        best[part] = max(best.get(part, 0.0), weight + random)
    reached.sort(reverse=True)
    seen: set[int] = set()
    for score, first in reached:  # the highest score of those that lead to an assignment comes to it first
        waiting = [first]
        while waiting:
            at = waiting.pop()
            if at in seen:
                continue
            seen.add(at)
            several = len(links.parts(at)) > 1
            for parts in links.parts(at):
                if several and not links._summed([p for p in parts if not isinstance(p, int)]).score() and all(not isinstance(p, int) for p in parts):
                    continue  # one of several alternatives, and plain
                for part in parts:
                    if isinstance(part, int):
                        waiting.append(part)
                    else:
                        best[part] = max(best.get(part, 0.0), score)
    return [(a, b, score) for (a, b), score in best.items() if b > a]


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by start and then kind; pattern spans score 1."""
    out = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    out += [("lexed", *x) for x in lexed(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    )
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, text_col: str = "text", to: str = "spans") -> DataFrame:
    """``docs`` with ``to``: the spans of each row's whole text."""
    docs = docs.drop(to) if to != text_col else docs
    schema = T.StructType([*docs.schema, T.StructField(to, SPANS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end", "score")
        for b in parts(batches):
            found = [[dict(zip(keys, s, strict=True)) for s in spans(t or "")] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _ARROW_SPANS)], names=[*b.schema.names, to])

    return map_batches(docs, find, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; touching spans share one."""
    schema = docs.schema

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text_col)
        for b in parts(batches):
            texts = pa.array([t and redacted(t, mark) for t in b.column(at).to_pylist()], b.schema.types[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 :]], names=b.schema.names)

    return map_batches(docs, clear, schema)


def redacted(text: str, mark: str) -> str:
    """``text`` with its spans replaced."""
    out, at = [], -1
    for _, start, end, _ in spans(text):
        if start > at:
            out += [text[max(at, 0) : start], mark]
        at = max(at, end)
    return "".join([*out, text[max(at, 0) :]])


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), of("lexed"))

"""Line-first quality cleaning with DataFrame functions only.

Every line is judged on its own by four rules: navigation (separators), boilerplate (phrases),
markup (symbols) and terminal punctuation (a line of one or two words that doesn't end as a
sentence does). Failing lines are removed; a document that loses too large a share of its
words, or fails the whole-text floor rules, is rejected. No step shuffles: a document is
judged inside its own row.

Defined cases: null and empty texts have no words, all counts 0, and are rejected
(too few words). Repeated rows give repeated results; an empty table gives an empty result;
texts of any length are judged whole. Extra input columns pass through
``clean`` untouched unless they carry one of the names it adds, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, let, n_words, read, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Largest share of words, in percent, that a document may lose with its failing lines.
MAX_LOST_PERCENT = 50
#: Symbols that count as markup noise.
SYMBOLS = "#*$%&|<>"
#: A line with at least so many separators is navigation if they outnumber a third of its words.
MIN_SEPARATORS = 3
#: Lines of at most so many words are dropped when they hold a boilerplate phrase.
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "use of cookies",
    "accept cookies", "enable javascript", "click here", "sign in", "log in", "sign up", "subscribe to",
    "read more", "back to top", "share this", "lorem ipsum", "page not found",
)

SEPARATORS = "|»›•·"
MARKS = "#*$%&|<>{}~^=_\\\\"
#: Every phrase from its first space on, in lower case: what a text with a phrase must hold.
PHRASE_TAIL = " (?:" + "|".join(sorted({p.split(" ", 1)[1] for p in BOILERPLATE})) + ")"
#: Ends of sentences, with what may close after them, and of lines that lead on to others.
TERMINAL = ".!?\u2026:;,\"'\u201d\u2019\u00bb)\\]}\u3002\uff01\uff1f"
_BLANK = "[\\x20\\x09\\x0B-\\x0D]"
#: A line of one or two words whose last character ends nothing.
FRAGMENT = f"{_BLANK}*(?:[^{SPACES}]+{_BLANK}+)?[^{SPACES}]*[^{SPACES}{TERMINAL}]{_BLANK}*"


def repeated_window_words(tokens: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more in the row.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """

    def positions(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def same(s: Column) -> Column:
            hit = F.transform(
                s,
                lambda e, i: F.when(
                    ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
                    e["i"],
                ),
            )
            return F.array_sort(F.filter(hit, lambda p: p.isNotNull()))

        return let(tagged, same)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_hashes(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(positions(h), covered))

    def windows(wh: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(wh) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))

    def of_words(wh: Column) -> Column:
        return F.when(F.size(wh) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows(wh), of_hashes))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_words)


def count_of(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` in a regex class."""
    return F.size(F.split(text, char_class, -1)) - 1


def has_phrase(lower: Column) -> Column:
    """True if the lower-case text holds a boilerplate phrase."""
    return reduce(or_, [lower.contains(p) for p in BOILERPLATE])


def line_fails(line: Column, may_have_phrase: Column) -> Column:
    """True for a line of navigation, boilerplate or markup noise, and for a fragment.

    ``may_have_phrase``: false if the whole text is known to hold no boilerplate phrase.
    Words of the line are counted only where a cheaper test has already hit.
    """
    separators = count_of(line, f"[{SEPARATORS}]")
    navigation = (separators >= MIN_SEPARATORS) & (separators * 3 >= n_words(line))
    symbols = count_of(line, f"[{MARKS}]")
    punctuation = (symbols > 0) & (symbols * 2 > n_words(line))
    boilerplate = may_have_phrase & has_phrase(F.lower(line)) & (n_words(line) <= BOILERPLATE_WORDS)
    return navigation | punctuation | boilerplate | line.rlike(f"\\A{FRAGMENT}\\z")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, the verdict and the text that is left after line cleaning.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left (long),
    base_failed, kept (boolean) and clean_text (string; null stays null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = words(text)
    worded = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    dup_lines = let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # One pass over the whole text each: most texts hold neither a mark nor a phrase nor a fragment, and then no line can fail.
    marked, phrased = text.rlike(f"[{SEPARATORS}{MARKS}]"), F.lower(text).rlike(PHRASE_TAIL)
    broken = text.rlike(f"(?:\\A|\\n){FRAGMENT}(?=\\n|\\z)")
    good_lines = let(phrased, lambda may: F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x, may)))
    stats = let(
        tokens,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    added = {"_stats": stats, "n_symbols": count_of(text, "[#*$%&|<>]").cast("long"), "n_dup_lines": dup_lines.cast("long")}
    added["clean_text"] = F.when(~(marked | phrased | broken), F.col(text_col)).when(
        F.col(text_col).isNotNull(), F.array_join(good_lines, "\n")
    )
    out = docs.withColumns(added)
    out = out.withColumns({n: F.col("_stats")[n] for n in ("n_words", "word_chars", "n_repeat_words")}).drop("_stats")
    same = F.col("clean_text").eqNullSafe(F.col(text_col))
    out = out.withColumn("words_left", F.when(same, F.col("n_words")).otherwise(n_words(F.col("clean_text"))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = (F.col("n_words") - F.col("words_left")) * 100 > F.col("n_words") * MAX_LOST_PERCENT
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    got = clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_FRAGMENT = FRAGMENT.replace("'", "''")
OP5_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_W}') AS w FROM t),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM t),
l AS (
  SELECT r, line, lower(line) AS low, len(regexp_extract_all(line, '{_W}')) AS n, len(regexp_extract_all(line, '[{SEPARATORS}]')) AS sep,
    len(regexp_extract_all(line, '[{MARKS}]')) AS marks, regexp_matches(line, '\A{_FRAGMENT}\z') AS fragment FROM lines),
f AS (
  SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup,
    coalesce(sum(n) FILTER (NOT (sep >= {MIN_SEPARATORS} AND sep * 3 >= n OR marks > 0 AND marks * 2 > n OR fragment OR n <= {BOILERPLATE_WORDS} AND ({_PHRASES}))), 0) AS words_left
  FROM l GROUP BY r),
k AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM k) WHERE c > 1),
rep AS (SELECT r, sum(d) AS n FROM (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS d FROM s) GROUP BY r),
c AS (
  SELECT t.r, doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, words_left
  FROM t JOIN w ON w.r = t.r JOIN f ON f.r = t.r LEFT JOIN rep ON rep.r = t.r),
v AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words - words_left) * 100 > n_words * {MAX_LOST_PERCENT} AS kept FROM v
"""

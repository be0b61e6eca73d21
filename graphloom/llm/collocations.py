"""Phrase collocations from suffix arrays of word ids.

Each shard (the texts of a task, up to ``SHARD_WORDS`` words of a language at a time) turns
words into ids, orders the places by prefix doubling in numpy, and reads the n-grams and their
counts off the intervals of places with n equal words. Counts are merged by phrase over all
shards.

Lengths are counted one after another, the last two at once. A phrase occurs ``least`` times
only if all shorter phrases in it do, so from two words on only places are ordered where those
of the length before are frequent. Which are is told to the tasks in a bitmap of hashes, of at most 2**``most_bits``
bits however many there are: a wrong hit costs time, never a result.

Defined cases: null text counts as empty, null language as ``und``; texts without words and an
empty table give no rows; a row counts as often as it is there; ids and other columns are not
read. Texts of any length are read in slices; what a task holds is bounded by a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, materialise, read
from graphloom.plans.ranges import numbered

LONGEST = 5
LEAST = 100
TOP = 2_000
SHARD_WORDS = 3_000_000
#: Bytes of a text that are cut into words at once.
SLICE = 4_000_000
MOST_BITS = 28
UNKNOWN = "und"
_SEPARATORS = b".,;:!?\n\v\f\r"
_TO = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _SEPARATORS, bytes(range(97, 123)) + b" " + b"\n" * len(_SEPARATORS))
_BETWEEN, _NOTHING = 0, 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, phrase string, n long"


class _Ids(dict):
    """Ids of words in the order they come; 0 is the place between pieces, 1 no word."""

    def __init__(self):
        super().__init__({b"\n": _BETWEEN, b"": _NOTHING})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def word_ids(text: bytes, ids: _Ids) -> Iterator[np.ndarray]:
    """Ids of the words of a text, slice by slice, with 0 between pieces."""
    begin = 0
    while begin < len(text):
        part = text[begin : begin + SLICE].translate(_TO)
        if begin + SLICE < len(text):
            end = max(part.rfind(b" "), part.rfind(b"\n"))
            while end < 0:  # a word longer than a slice
                more = text[begin + len(part) : begin + len(part) + SLICE].translate(_TO)
                part += more
                end = max(part.rfind(b" "), part.rfind(b"\n")) if more else len(part) - 1
            part = part[: end + 1]
        begin += len(part)
        found = np.fromiter(map(ids.__getitem__, part.replace(b"\n", b" \n ").split(b" ")), np.int64)
        yield found[found != _NOTHING]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): places by key, and for each place the number of its key among the distinct ones."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    return order, rank


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next ``depth`` words or more, by prefix doubling."""
    order, rank = _ranks(ids)
    width = 1
    while width < depth:
        after = np.zeros(len(ids), np.int64)
        after[: max(len(ids) - width, 0)] = rank[width:] + 1
        order, rank = _ranks(rank * (len(ids) + 1) + after)
        width *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each place of ``order`` has in common with the one before, up to ``depth``."""
    padded = np.concatenate([ids, np.full(depth, -1, np.int64)])
    out = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(depth):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        out[1:] += same
    return out


def ngram_counts(ids: np.ndarray, wanted: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n of ``wanted`` (place, count) of every distinct n-gram: one place where it is, and how many wanted places it has."""
    depth = max(wanted)
    whole, out = suffix_array(ids, depth), {}
    for n, places in wanted.items():
        order = whole[places[whole]]
        first = np.flatnonzero(common_prefixes(ids, order, n) < n)
        out[n] = order[first], np.diff(np.append(first, len(order)))
    return out


def _word_hash(word: bytes, lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def _combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (of n fewer places, less one)."""
    size = max(len(hashes) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _FACTOR + hashes[k : k + size]
    out ^= out >> np.uint64(29)
    return out * _FACTOR


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(frequent: DataFrame, n: int, most_bits: int = MOST_BITS) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the hashes of frequent phrases of n words; at most 2**most_bits bits are collected."""
    bits = max(16, min(most_bits, int(frequent.count() * 32).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            each = np.array([[_word_hash(w, lang) for w in phrase.encode().split(b" ")] for lang, phrase in rows], np.uint64).reshape(-1, n)
            at = np.array([_combined(h, n)[0] for h in each], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(at, bits))], names=["at"])

    places = map_batches(frequent.select("lang", "phrase"), run, "at long")
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("x")).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return bits, found


class _Shard:
    """Words of one language in a task, until their n-grams are counted."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, _Ids(), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.size += len(ids)

    def counted(self, sizes: tuple[int, ...], known: tuple[int, int, np.ndarray] | None, last: bool) -> pa.RecordBatch:
        """The n-grams of ``sizes`` that start in the shard; unless it is the last, what may go on in the next stays for it."""
        ids = np.concatenate([*self.parts, np.zeros(0, np.int64)]).astype(np.int64)
        words = list(self.ids)
        stop = len(ids) if last else max(len(ids) - max(sizes) + 1, 0)
        clear = np.concatenate([ids != _BETWEEN, np.zeros(max(sizes), bool)])
        if known is not None:
            m, bits, table = known
            hashes = np.array([_word_hash(w, self.lang) for w in words], np.uint64)[ids]
            at = _buckets(_combined(hashes, m), bits)
            hit = np.concatenate([(table[at >> 6] >> (at & 63) & 1).astype(bool), np.zeros(len(ids) + max(sizes) - len(at), bool)])
        wanted = {}
        for n in sizes:
            wanted[n] = np.logical_and.reduce([clear[k : k + len(ids)] for k in range(n)])
            wanted[n][stop:] = False
            if known is not None:
                wanted[n] &= np.logical_and.reduce([hit[k : k + len(ids)] for k in range(n - m + 1)])
        # only what wanted n-grams cover is ordered, with a place between what isn't adjacent
        edge = np.zeros(len(ids) + max(sizes) + 1, np.int64)
        for n, places in wanted.items():
            edge[: len(ids)] += places
            edge[n : n + len(ids)] -= places
        covered = np.flatnonzero(np.cumsum(edge) > 0)
        gaps = np.flatnonzero(np.diff(covered) > 1) + 1
        short = np.insert(ids[covered], gaps, _BETWEEN)
        marks = {n: np.insert(places[covered], gaps, False) for n, places in wanted.items()}
        vocabulary, phrases, counts = pa.array(words, pa.binary()), [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
        for n, (place, count) in ngram_counts(short, marks).items():
            columns = [vocabulary.take(pa.array(short[place + k])) for k in range(n)]
            phrases.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if n > 1 else columns[0])
            counts.append(count)
        phrase = pa.concat_arrays(phrases).cast(pa.string())
        if 1 in sizes:
            phrase = pa.concat_arrays([phrase, pa.array([None], pa.string())])
            counts.append([np.count_nonzero(clear[:stop])])
        stays, self.ids = [words[i] for i in ids[stop:].tolist()], _Ids()
        self.parts = [np.array([self.ids[w] for w in stays], np.int64)] if stays else []
        self.size = len(stays)
        lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(phrase), np.int64)))
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, sizes: tuple[int, ...], known: tuple[int, int, np.ndarray] | None, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, n): how often each phrase of ``sizes`` words occurs; with size 1 a row without phrase has the number of all words.

    With a bitmap of the frequent phrases of fewer words (their size, bits, bitmap), phrases
    that can't be frequent are left out (a few may stay).
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(known) if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        bits = told.value if told else None
        between = np.zeros(1, np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                shard = shards.setdefault(lang, _Shard(lang))
                for ids in word_ids(text.as_py(), shard.ids):
                    shard.add(ids)
                    if shard.size >= shard_words:
                        yield shard.counted(sizes, bits, False)
                shard.add(between)
            if sum(s.size for s in shards.values()) >= 2 * shard_words:  # many languages
                yield from (s.counted(sizes, bits, True) for s in shards.values())
                shards.clear()
        yield from (s.counted(sizes, bits, True) for s in shards.values())

    rows = docs.select(F.col(text_col), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang")).filter(F.length(text_col) > 0)
    return map_batches(rows, run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS, shard_words: int = SHARD_WORDS) -> list[DataFrame]:
    """(lang, phrase, n) of the phrases that occur ``least`` times or more, stored; first single words and the numbers of all words, then longer ones."""
    out, known = [], None
    steps = [(n,) for n in range(1, longest - 1)] + [(longest - 1, longest)] if longest > 3 else [(n,) for n in range(1, longest + 1)]
    for sizes in steps:
        counts = phrase_counts(docs, sizes, known, text_col, lang_col, shard_words)
        out.append(materialise(counts.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases"))
        frequent = out[-1].filter("phrase IS NOT NULL")
        if sizes == steps[-1] or frequent.isEmpty():
            break
        known = (sizes[-1], *bitmap(frequent, sizes[-1], most_bits))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): every phrase of 2 words or more that occurs ``least`` times, unless a longer one has all its occurrences.

    a, l and r are the counts of the phrase and of its two parts at the cut with the lowest
    score, n the number of words of the language.
    """
    levels = frequent_phrases(docs, longest, least, text_col, lang_col, most_bits, shard_words)
    totals = levels[0].filter("phrase IS NULL").select("lang", F.col("n").alias("n"))
    counts = _union([f.filter("phrase IS NOT NULL") for f in levels])
    if len(levels) == 1:
        longer = counts.limit(0)
    else:
        longer = _union(levels[1:])
    longer = longer.select("lang", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    last = F.size(words)
    # what holds a phrase's every occurrence holds them in one word more already
    inner = longer.select("lang", "a", words.alias("w")).filter(F.size("w") > 2)
    shorter = F.explode(F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1)))
    held = inner.select("lang", shorter.alias("w"), "a").select("lang", F.array_join("w", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    rows = longer.join(held, ["lang", "phrase"], "left").filter(F.col("_most").isNull() | (F.col("_most") < F.col("a")))
    cut = rows.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), last - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_l"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("_r"))
    left, right = counts.select("lang", F.col("phrase").alias("_l"), F.col("n").alias("l")), counts.select("lang", F.col("phrase").alias("_r"), F.col("n").alias("r"))
    both = cut.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")).cast("decimal(34,0)")).cast("decimal(38,0)")
    both = both.withColumn("_over", over).withColumn("_under", (big("l") * big("r")).cast("decimal(38,0)"))
    scored = both.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank, by score, count and phrase."""
    placed = numbered(found, ["lang", F.col("score").desc(), F.col("a").desc(), "phrase"], "_pos")
    first = placed.groupBy("lang").agg(F.min("_pos").alias("_first"))  # one row a language
    both = placed.join(F.broadcast(first), "lang").withColumn("rank", F.col("_pos") - F.col("_first") + 1)
    return both.filter(F.col("rank") <= top).drop("_pos", "_first")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases by score."""
    found = collocations(read(spark, sf_dir, "documents"))
    return ranked(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = """WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM places, unnest(range(1, 6)) AS u(size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), inside AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[s : s + k - 1], ' ') AS phrase, max(c.f) AS f
  FROM grams c, unnest(range(2, c.size)) AS u(k), unnest(range(1, c.size - k + 2)) AS v(s) WHERE c.size >= 3 GROUP BY ALL
), kept AS (
  SELECT c.lang, c.phrase, c.size, c.f FROM grams c LEFT JOIN inside d ON d.lang = c.lang AND d.phrase = c.phrase
  WHERE c.size >= 2 AND (d.f IS NULL OR 100 * d.f < 100 * c.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, k, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1 : k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

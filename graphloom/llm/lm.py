"""Subword lattice likelihood of whole texts.

A word's probability sums over all ways to spell it from the pieces of an existing
vocabulary, by a forward recursion over the word's bytes in log space. The vocabulary's own
scores (as ranks, 1 / (rank + RANK_SHIFT)) weight the pieces at first; they stay as a prior,
and ROUNDS times the pieces' expected counts over all spellings of all distinct training
words are added to it (backward recursion). A piece that starts a word and one that goes on
have separate weights, and a word's end has one of its own. Training words are arcs of the
lattice too, over the whole word, by their counts less an absolute discount; the discounts'
sum is the share of spellings. ``lattice_score`` leaves these arcs out.

All weights are kept for a few classes of texts (the most common labels of the training
rows; the last class takes the rest). A text's probability sums over the classes: the share
of a class times the product over the text's words and one end. A text's own label is never
used to score it. All of it is in double precision.

Words are counted, scored and joined as a table of distinct words, of which only the counts
are stored; the recursions run over batches of words of one length. Words that make up at
least 1 / FREQUENT of the training words are looked up in place: there are at most FREQUENT
of them, so what is broadcast is bounded (two doubles a class each), and no key of the join
of the others is hot.

Defined cases: null text is empty (one end); with no training rows the base score is 0 a
token and spellings alone give the score; an empty table gives an empty result; texts and
words of any length are scored whole; repeated rows each count and are scored alike; ids may
be null (the empty text in the fold); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import crc_remainder, let, map_batches, materialise, read

VOCABULARY = "piece_bpe_32k.model"
FREQUENT = 1 << 18
#: Pseudo-count of a vocabulary's own scores, and what is added to a rank before it divides.
PRIOR, RANK_SHIFT = 50.0, 10.0
#: Rounds of expected counts.
ROUNDS = 4
MARK = "▁".encode()
#: Classes of texts, at most.
CLASSES = 8
#: Bytes of the words that a recursion runs over at once.
STEP_BYTES = 1 << 16
#: Distinct words that a task holds before it hands their counts on.
HELD = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[bytes | None], np.ndarray]:
    """Bytes of each piece (None for control pieces) and its weight by the file's scores."""
    sp = _processor(path)
    n = sp.get_piece_size()
    text: list[bytes | None] = []
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            text.append(None)
        elif sp.is_byte(i):
            text.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
        else:
            text.append(sp.id_to_piece(i).encode())
    scores = np.array([sp.get_score(i) for i in range(n)])
    rank = np.empty(n)
    rank[np.lexsort((np.arange(n), -scores))] = np.arange(n)
    # Byte pieces carry no score of their own: they come after all others.
    for i in range(n):
        if sp.is_byte(i):
            rank[i] = n
    return text, 1.0 / (rank + RANK_SHIFT)


class Trie:
    """The pieces as prefix trees, one for the start of a word and one for the rest; a node may end pieces.

    ``table[row[node], byte]`` is the next node; ``n`` stands for none. Node 0 is the mark
    before a word alone, node 1 the root of the rest.
    """

    def __init__(self, path: str):
        text, weight = _pieces(path)
        ids: dict[tuple[int, bytes], int] = {(0, b""): 0, (1, b""): 1}
        below: dict[int, dict[int, int]] = {}
        ends: dict[int, float] = {}
        for t, x in zip(text, weight, strict=True):
            if t is None:
                continue
            root, t = (0, t[len(MARK) :]) if t.startswith(MARK) else (1, t)
            at = ids[root, b""]
            for j in range(1, len(t) + 1):
                below.setdefault(at, {}).setdefault(t[j - 1], ids.setdefault((root, t[:j]), len(ids)))
                at = ids[root, t[:j]]
            ends[at] = ends.get(at, 0.0) + x
        self.n = n = len(ids)
        inner = sorted(below)
        self.row = np.full(n + 1, len(inner), dtype=np.int32)
        self.row[inner] = np.arange(len(inner))
        self.table = np.full((len(inner) + 1, 256), n, dtype=np.int32)
        for i in inner:
            for byte, child in below[i].items():
                self.table[self.row[i], byte] = child
        self.starts = np.zeros(n + 1, dtype=bool)
        self.starts[[i for (root, _), i in ids.items() if root == 0]] = True
        self.weight = np.zeros(n + 1)
        self.weight[list(ends)] = list(ends.values())
        self.ends = self.weight > 0


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(path)


class Lattice:
    """Log weights of a vocabulary's pieces in each class, and the recursions over them.

    ``counts``: (expected) counts by class and node; ``types``: distinct words by class.
    """

    def __init__(self, path: str, counts: np.ndarray, types: np.ndarray):
        t = trie(path)
        self.path, self.classes = path, len(types)
        shares = []
        for chosen, ends in ((t.starts, np.zeros(len(types))), (~t.starts, types + PRIOR)):
            prior = np.where(chosen, t.weight, 0.0)
            mass = np.where(chosen & t.ends, counts, 0.0) + PRIOR * prior / prior.sum()
            shares.append(mass / (mass.sum(axis=1) + ends)[:, None])
        with np.errstate(divide="ignore"):
            self.log = np.log(np.where(t.starts, *shares))
        self.end = np.log1p(-shares[1].sum(axis=1))

    def _forward(self, words: np.ndarray, cls: np.ndarray | None = None) -> tuple[np.ndarray, list, np.ndarray]:
        """For words of one length (rows of bytes): log sums at each place, the arcs in order with their weights, and the ends.

        In all classes, or each word in its own class of ``cls``.
        """
        t = trie(self.path)
        n_words, size = words.shape
        every = cls is None
        end = self.end[:, None] if every else self.end[cls]
        alpha = np.full((size + 1, self.classes, n_words) if every else (size + 1, n_words), -np.inf)
        arcs = []

        def walk(i: int, root: int, base: np.ndarray | float) -> None:
            at, node = np.arange(n_words), np.full(n_words, root, dtype=np.int32)
            for j in range(i, size):
                node = t.table[t.row[node], words[at, j]]
                ok = node < t.n
                if not ok.all():
                    at, node = at[ok], node[ok]
                    if not len(at):
                        return
                whole = t.ends[node]
                if whole.any():
                    some, of = (at, node) if whole.all() else (at[whole], node[whole])
                    w = self.log[:, of] if every else self.log[cls[some], of]
                    so_far = base[..., some] if root else 0.0
                    alpha[j + 1][..., some] = np.logaddexp(alpha[j + 1][..., some], so_far + w)
                    arcs.append((i, j + 1, root, some, of, w))

        walk(0, 0, 0.0)
        alpha[0] = self.log[:, :1] if every else self.log[cls, 0]
        for i in range(size):
            walk(i, 1, alpha[i])
        return alpha, arcs, end

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log, for each word and class, of the summed weight of all spellings."""
        out = np.empty((len(words), self.classes))
        for at, rows in _by_length(words):
            alpha, _, end = self._forward(rows)
            out[at] = (alpha[-1] + end).T
        return out

    def expected(self, words: list[bytes], has: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces by class and node; ``has``: true where a class learns from a word."""
        width = trie(self.path).n + 1
        total = np.zeros(self.classes * width)
        for at, rows in _by_length(words):
            row, cls = np.nonzero(has[at])
            alpha, arcs, end = self._forward(rows[row], cls)
            z = alpha[-1] + end
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = end
            places, shares = [], []
            for i, j, root, some, of, w in reversed(arcs):
                tail = w + beta[j][some]
                if root:
                    beta[i][some] = np.logaddexp(beta[i][some], tail)
                shares.append(np.exp((alpha[i][some] if root else 0.0) + tail - z[some]))
                places.append(cls[some] * width + of)
            shares.append(np.exp(alpha[0] + beta[0] - z))
            places.append(cls * width)
            total += np.bincount(np.concatenate(places), weights=np.concatenate(shares), minlength=len(total))
        return total.reshape(self.classes, width)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, in steps of bounded size, and their bytes as rows."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(1, STEP_BYTES // int(size + 1))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield some, np.frombuffer(b"".join(words[j] for j in some), dtype=np.uint8).reshape(len(some), int(size))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: ``bytes`` methods know ASCII letters and white space only."""
    return (text or "").encode().lower().split()


def classes_of(docs: DataFrame, label: str, most: int = CLASSES) -> list:
    """The most common labels of ``docs``, at most ``most`` - 1; all other rows share one more class."""
    top = docs.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return [r[label] for r in top.orderBy(F.col("n").desc(), label).limit(most - 1).collect()]


def count_words(docs: DataFrame, n_classes: int) -> DataFrame:
    """(word, c): every word of ``docs`` (text, class) and its counts by class.

    Rows with a null class are not learned from: their words are there, with no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(n_classes)]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counter in enumerate(seen):
                cols = [pa.array(counter.keys(), pa.binary()), pa.array([k] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "class", "n"])
                counter.clear()

        for b in batches:
            for text, k in zip(b.column("text").to_pylist(), b.column("class").to_pylist(), strict=True):
                if k is None:
                    for w in set(words_of(text)):
                        seen[0].setdefault(w, 0)
                else:
                    seen[k].update(words_of(text))
                if sum(map(len, seen)) > HELD:
                    yield from flush()
        yield from flush()

    counted = map_batches(docs.select("text", "class"), run, "word binary, class int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(n_classes)]
    return counted.groupBy("word").agg(*sums).select("word", F.array(*[f"c{k}" for k in range(n_classes)]).alias("c"))


def learn(counts: DataFrame, path: str, types: np.ndarray, rounds: int = ROUNDS) -> Lattice:
    """The lattice of the words of ``counts``, after so many rounds of expected counts over all of them."""
    n_classes, n = len(types), trie(path).n
    learnt = counts.filter(F.exists("c", lambda x: x > 0)).select("word", "c")
    lattice = Lattice(path, np.zeros((n_classes, n + 1)), types)
    for _ in range(rounds if types.any() else 0):
        shared = counts.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = shared.value
            total = np.zeros((n_classes, n + 1))
            for b in batches:
                total += lattice.expected(b.column("word").to_pylist(), np.array(b.column("c").to_pylist()) > 0)
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(total[k, at], pa.float64())], names=["class", "node", "x"])

        # At most one row for each class and node of the vocabulary's trees.
        got = map_batches(learnt, run, "class long, node long, x double").groupBy("class", "node").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros((n_classes, n + 1))
        total[got.column("class").to_numpy(), got.column("node").to_numpy()] = got.column("x").to_numpy()
        lattice = Lattice(path, total, types)
    return lattice


def score_words(counts: DataFrame, lattice: Lattice, n_words: list[int], types: list[int], once: list[int], twice: list[int], p_end: float) -> DataFrame:
    """(word, c: count in all classes, lp: log10 of the probability of the word in each class, and then what is added to it for spelling alone).

    What is added is one number a class for words without a count there, which are most: those bytes vanish when rows are shuffled.
    """
    n = np.array(n_words, dtype=float)
    discount = (np.array(once) + 1.0) / (np.array(once) + 2.0 * np.array(twice) + 2.0)
    freed = discount * np.array(types)
    spelled = np.where(n > 0, (freed + 1) / (n + 1), 1.0)
    with np.errstate(divide="ignore"):
        log_spelled, log_whole = np.log(spelled), np.log(1 - spelled) - np.log(np.maximum(n - freed, 1e-300))
    rest, ten = math.log(1 - p_end), math.log(10)
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.array(b.column("c").to_pylist(), dtype=np.int64).reshape(b.num_rows, len(n))
            alone = shared.value.log_probabilities(b.column("word").to_pylist())
            with np.errstate(divide="ignore"):
                whole = np.where(c > 0, np.log(np.maximum(c - discount, 0.0)) + log_whole, -np.inf)
            model = np.logaddexp(alone + log_spelled, whole)
            lp = np.concatenate([model + rest, np.where(c > 0, alone - model, -log_spelled)], axis=1) / ten
            rows = pa.ListArray.from_arrays(np.arange(0, lp.size + 1, lp.shape[1], dtype=np.int32), pa.array(lp.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(c.sum(axis=1), pa.int64()), rows], names=["word", "c", "lp"])

    return map_batches(counts.select("word", "c"), run, "word binary, c long, lp array<double>")


def score(docs: DataFrame, held_out, label: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and ``label`` if named): doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, lattice_score. ``held_out``: a column, true for rows not learned from.
    """
    path = vocabulary or default_vocabulary()
    own = F.col(label) if label else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", own.alias("label"), held_out.alias("held_out"))
    labels = classes_of(docs.filter(~F.col("held_out")), "label")
    k_all = len(labels) + 1
    of_label = F.lit(len(labels))
    for k, name in enumerate(labels):
        of_label = F.when(F.col("label") == name, F.lit(k)).otherwise(of_label)
    docs = docs.withColumn("class", F.when(~F.col("held_out"), of_label)).drop("label")
    docs = docs.withColumn("_row", F.monotonically_increasing_id())

    counts = materialise(count_words(docs, k_all), "words")
    per_class = {r["class"]: r["n"] for r in docs.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    class_docs = [per_class.get(k, 0) for k in range(k_all)]
    train_docs = sum(class_docs)
    any_count = F.exists("c", lambda x: x > 0)
    sums = [F.coalesce(F.sum(F.col("c")[k]), F.lit(0)).alias(f"n{k}") for k in range(k_all)]
    for name, holds in (("t", lambda x: x > 0), ("o", lambda x: x == 1), ("d", lambda x: x == 2)):
        sums += [F.count_if(holds(F.col("c")[k])).alias(f"{name}{k}") for k in range(k_all)]
    stats = counts.agg(F.count_if(any_count).alias("v"), *sums).first()
    n_words, types, once, twice = ([stats[f"{name}{k}"] for k in range(k_all)] for name in "ntod")
    n, v = sum(n_words) + train_docs, stats["v"] + (train_docs > 0)
    below = n + 1 * (v + 1)
    p_end = (train_docs + 1) / (n + 2)
    lattice = learn(counts, path, np.array(types, dtype=float))
    least = max(1, -(-sum(n_words) // FREQUENT))
    in_all = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    scored = lambda some: score_words(counts.filter(some), lattice, n_words, types, once, twice, p_end)
    often = scored(in_all >= least).toArrow()  # at most FREQUENT rows
    base = lambda c: math.log10((c + 1) / below)
    place = {w: i for i, w in enumerate(often.column("word").to_pylist())}
    logs_of = np.array([(base(c), *lp) for c, lp in zip(often.column("c").to_pylist(), often.column("lp").to_pylist(), strict=True)]).reshape(len(place), 1 + 2 * k_all)
    shared = docs.sparkSession.sparkContext.broadcast((place, logs_of))
    end = np.array([base(train_docs), *[math.log10(p_end)] * k_all, *[0.0] * k_all])
    end_known = int(train_docs > 0)
    id_type = docs.schema["doc_id"]
    fields = [("held_out", T.BooleanType()), ("_row", T.LongType()), ("word", T.BinaryType()), ("n", T.LongType()), ("known", T.LongType()), ("logs", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([id_type, *(T.StructField(*f) for f in fields)])
    logs_type = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its word is null), and one for each of its words not looked up in place."""
        place, logs_of = shared.value
        of = place.get
        for b in batches:
            rows, words, ns = [], [], []
            tokens, knowns, logs = [], [], []
            for text, row in zip(b.column("text").to_pylist(), b.column("_row").to_pylist(), strict=True):
                n_tokens, known, got, times = 1, end_known, [], []
                for w, k in Counter(words_of(text)).items():
                    n_tokens += k
                    if (found := of(w)) is not None:
                        got.append(found)
                        times.append(k)
                        known += k
                    else:
                        rows.append(row)
                        words.append(w)
                        ns.append(k)
                tokens.append(n_tokens)
                knowns.append(known)
                logs.append((end + np.array(times, dtype=float) @ logs_of[got] if got else end).tolist())
            own = [b.column("doc_id"), b.column("held_out"), b.column("_row"), pa.nulls(b.num_rows, pa.binary()), pa.array(tokens, pa.int64()), pa.array(knowns, pa.int64()), pa.array(logs, logs_type)]
            yield pa.RecordBatch.from_arrays(own, names=schema.names)
            if k := len(rows):
                rest = [pa.nulls(k, b.column("doc_id").type), pa.nulls(k, pa.bool_()), pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(ns, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, logs_type)]
                yield pa.RecordBatch.from_arrays(rest, names=schema.names)

    parts = materialise(map_batches(docs.drop("class"), run, schema), "parts")
    # Scored on their way to the join, not stored: the scores of all words outweigh the input. The size of
    # what Python returns is guessed from the stored words, so the join is told not to broadcast it.
    rare = parts.filter("word IS NOT NULL").select("_row", "word", "n").join(scored(in_all < least).hint("merge"), "word")
    log_base = F.log10((F.col("c") + 1) / F.lit(float(below)))
    sums = [F.sum(F.col("n") * F.col("lp")[k]).alias(f"s{k}") for k in range(2 * k_all)]
    rare = rare.groupBy("_row").agg(F.sum(F.col("n") * log_base).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more"), *sums)
    out = parts.filter("word IS NULL").drop("word").join(rare, "_row", "left")
    total = lambda at, name: F.col("logs")[at] + F.coalesce(name, F.lit(0.0))
    share = [math.log10((c + 1) / (train_docs + k_all)) for c in class_docs]

    by_model = [total(k + 1, f"s{k}") for k in range(k_all)]
    by_spelling = [by_model[k] + total(k_all + k + 1, f"s{k_all + k}") for k in range(k_all)]

    def over_classes(logs: list[Column]) -> Column:
        each = F.array(*[x + F.lit(y) for x, y in zip(logs, share, strict=True)])
        best = lambda xs: F.array_max(xs)
        add = lambda xs: best(xs) + F.log10(F.aggregate(F.transform(xs, lambda x: F.pow(F.lit(10.0), x - best(xs))), F.lit(0.0), lambda a, x: a + x))
        return let(each, add)

    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), total(0, "s").alias("base_score"), over_classes(by_model).alias("score"), over_classes(by_spelling).alias("lattice_score"),
    )


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probabilities of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score(docs, crc_remainder(F.col("doc_id"), 7) == 2, label="lang")

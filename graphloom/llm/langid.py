"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths run over them, each filter's largest value in
a window is kept, and a softmax layer gives the language. Whole texts are cut into windows
of a fixed length; a text's language is that of its windows' mean log-probabilities.

Training takes a bounded sample of windows, drawn from all windows of all training texts by a
hash of id and place: TRAIN_PER_LANGUAGE of each language, TRAIN_TOTAL in all. Windows are
cut where the texts are; the driver gets windows, not texts.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with
score 0; so is everything if no training text has a language (an empty table, say); of
languages that are equally likely the first by name is given; repeated rows give
repeated results; a text of any length is read whole, STEP windows at a time; ids may be
null (they count as the empty text in the fold); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import crc_remainder, map_batches, read

EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
WINDOW_BYTES = 256
TRAIN_PER_LANGUAGE, TRAIN_TOTAL = 2_000, 40_000
#: Range of the hash that draws the sample, and how many windows more than wanted it may draw.
HASHES, SPARE = 1 << 40, 1.2
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Windows that a prediction step holds at once.
STEP = 64
UNKNOWN = "und"


@dataclass
class Model:
    """Parameters; ``kernel`` has one column a filter and EMBED rows for each place it may cover."""

    languages: list[str]
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray] | None = None

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """For the first and the second two places of a filter: what each pair of bytes adds to it."""
        if self.pairs is None:
            e, k = self.embed, self.kernel
            one = [e @ k[i * EMBED : (i + 1) * EMBED] for i in range(4)]
            # A pair's number is its first byte plus 256 times its second.
            self.pairs = tuple((one[i][None, :, :] + one[i + 1][:, None, :]).reshape(65_536, -1).astype(np.float32) for i in (0, 2))
        return self.pairs

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages of each window (rows of bytes, 0 after the end)."""
        low, high = self.lookup()
        n = windows.shape[1]
        out = np.empty((len(windows), len(self.languages)))
        for i in range(0, len(windows), STEP):
            w = np.zeros((min(STEP, len(windows) - i), n + 3), dtype=np.uint16)
            w[:, :n] = windows[i : i + STEP]
            pair = w[:, :-1] + (w[:, 1:] << 8)
            h = low[pair[:, :n]]
            h += high[pair[:, 2 : n + 2]]
            pooled = np.maximum(h.max(axis=1) + self.bias, 0)
            logits = pooled @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[i : i + STEP] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def cut(text: bytes, size: int = WINDOW_BYTES) -> np.ndarray:
    """The whole text as rows of ``size`` bytes, 0 after its end."""
    rows = max(1, -(-len(text) // size))
    out = np.zeros(rows * size, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(rows, size)


def _mask() -> np.ndarray:
    """1 where a filter covers a place."""
    return np.concatenate([np.repeat(np.arange(4) < w, EMBED)[:, None] * np.ones((1, FILTERS)) for w in WIDTHS], axis=1)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A network trained on all windows of labelled texts by Adam steps."""
    rows = [cut(t.encode()) for t in texts]
    return fit_windows(np.concatenate(rows), [label for label, r in zip(labels, rows, strict=True) for _ in r], epochs, seed)


def fit_windows(x: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A network trained on labelled windows (rows of bytes) by Adam steps."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(label) for label in labels])
    n_filters, places, mask = FILTERS * len(WIDTHS), 4 * EMBED, _mask()
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "kernel": rng.normal(0, 0.3, (places, n_filters)) * mask,
        "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.2, (n_filters, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    p["embed"][0] = 0
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mask = mask.astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            some = order[i : i + BATCH]
            grad = _gradient(p, x[some], y[some], mask)
            t += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            p["embed"][0] = 0
    return Model(languages, **p)


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross-entropy of a batch."""
    n, size = x.shape
    padded = np.zeros((n, size + 3), dtype=np.uint8)
    padded[:, :size] = x
    e = p["embed"][padded]
    columns = np.concatenate([e[:, j : j + size] for j in range(4)], axis=2)
    h = columns @ p["kernel"]
    at = h.argmax(axis=1)
    row = np.arange(n)[:, None]
    pooled = np.maximum(np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + p["bias"], 0)
    logits = pooled @ p["out"] + p["out_bias"]
    prob = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    d = prob
    d[np.arange(n), y] -= 1
    d /= n
    d_pooled = (d @ p["out"].T) * (pooled > 0)
    seen = columns[row, at]
    d_embed = np.zeros_like(p["embed"])
    d_seen = d_pooled[:, :, None] * p["kernel"].T[None]
    for j in range(4):
        np.add.at(d_embed, padded[row, at + j], d_seen[:, :, j * EMBED : (j + 1) * EMBED])
    return {
        "embed": d_embed,
        "kernel": np.einsum("bf,bfk->kf", d_pooled, seen, optimize=True) * mask,
        "bias": d_pooled.sum(axis=0),
        "out": pooled.T @ d,
        "out_bias": d.sum(axis=0),
    }


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """(window, lang) of the training sample: of each language the first windows by a hash of id and place.

    The windows of each language are counted first, by the texts' lengths; then a window is let
    through if its hash lies under its language's rate, so what leaves the scan is about what
    is wanted and no task gathers a language. What is left over is cut by the same hash.
    """
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    windows = F.ceil(F.octet_length("text") / WINDOW_BYTES).cast("long")
    counted = usable.groupBy("lang").agg(F.sum(windows).alias("n")).orderBy(F.col("n").desc(), "lang").limit(TRAIN_TOTAL)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    if not counts:
        return []
    each = max(1, min(TRAIN_PER_LANGUAGE, TRAIN_TOTAL // len(counts)))
    rates = [(lang, min(HASHES, round(HASHES * each * SPARE / n))) for lang, n in counts.items()]
    rates = docs.sparkSession.createDataFrame(rates, "lang string, _rate long")  # at most TRAIN_TOTAL rows
    keys = F.transform(F.sequence(F.lit(0).cast("long"), windows - 1), lambda i: F.struct(i.alias("at"), F.pmod(F.xxhash64("doc_id", "lang", i), F.lit(HASHES)).alias("key")))
    drawn = usable.join(F.broadcast(rates), "lang").withColumn("_w", F.explode(F.filter(keys, lambda k: k["key"] < F.col("_rate"))))
    window = F.substring(F.encode("text", "UTF-8"), (F.col("_w.at") * WINDOW_BYTES + 1).cast("int"), F.lit(WINDOW_BYTES))
    drawn = drawn.select(window.alias("window"), "lang", "_w.key", "doc_id", "_w.at").orderBy("key", "doc_id", "lang", "at").limit(2 * TRAIN_TOTAL).select("window", "lang").collect()
    kept: dict[str, int] = {}
    out = []
    for r in drawn:
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= each:
            out.append((bytes(r["window"]), r["lang"]))
    return out


def train(docs: DataFrame) -> Model | None:
    """A model of the rows of ``docs`` (doc_id, text, lang) that have both text and language."""
    rows = sample(docs)
    return fit_windows(np.concatenate([cut(w) for w, _ in rows]), [lang for _, lang in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with lang_pred and score, from the whole text."""
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names: list[str] = []
            scores: list[float] = []
            for text in b.column(text_col).to_pylist():
                if m is None or text is None or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                mean = m.log_probabilities(cut(text.encode())).mean(axis=0)
                prob = np.exp(mean - mean.max())
                best = int(prob.argmax())
                names.append(m.languages[best])
                scores.append(float(prob[best] / prob.sum()))
            cols = [*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_batches(docs.select(*keep, text_col), run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two folds of three."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)

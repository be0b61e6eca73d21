"""SentencePiece merge-type encoding of whole texts by backtracking, and decoding.

A segmentation is what the merges give exactly if each two adjacent pieces, put together and
merged again, come apart at the same place: until a merge crosses a boundary, the merges
inside a piece don't depend on what is outside it. So a text is read from the left: the
longest piece at a place (Aho-Corasick) is taken if it is compatible with the piece before
and its end isn't known to fail, else the next shorter one; where none is left, the place is
marked in a bitfield as failed and the piece before is shortened. A prefix of a text has one
compatible segmentation only, so a place fails whatever came before it.

No merge crosses two characters that are adjacent in no piece of the vocabulary, so texts are
cut there into runs, about words; those a worker has met are remembered, up to twice
``REMEMBERED``. Characters without a piece become the pieces of their bytes, or the unknown
piece where the model has none.

Defined cases: null text counts as empty (no tokens); repeated rows each give a row; ids may
be null or repeat; other input columns are not read; an empty table gives an empty one. A
text is encoded in the task that reads it, as its ids are one value, in memory that grows
with that text alone. Models whose pieces are not merged (another type, pieces defined by the
user, unused pieces) are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, read

VOCABULARY = "piece_bpe_32k.model"
#: Runs and pairs of pieces that a worker remembers; the others are worked out again.
REMEMBERED = 120_000
#: Longer runs are not remembered.
LONGEST = 32
#: Characters that are cut into runs at once.
WINDOW = 1_000_000
#: Rows that are encoded or decoded at once.
ROWS = 500
#: Characters that a table says of which pairs occur inside pieces; pairs of others are never cut.
MOST_CLASSES = 8_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Model:
    """The pieces of a merge-type model, and the segmentation that its merges give."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = processor(path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.processor.serialized_model_proto())
        if spec.trainer_spec.model_type != _BPE or {p.type for p in spec.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path} is not a model of merged pieces only")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.ids, self.count = normal, len(spec.pieces)
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        self.text = [p.piece for p in spec.pieces]
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == _UNKNOWN)
        of_byte = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.bytes = [of_byte[f"<0x{b:02X}>"] for b in range(256)] if of_byte else None
        #: Adjacent characters inside some piece; between others no merge can cross.
        self.inside = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        joined = sorted({c for pair in self.inside for c in pair})[:MOST_CLASSES]
        place = {c: i + 1 for i, c in enumerate(joined)}
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        self.joins = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for a, b in self.inside:
            self.joins[place.get(a, 0), place.get(b, 0)] = True
        self.automaton = ahocorasick.Automaton()
        for piece, i in normal.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.text]
        #: The next shorter piece that a piece starts with; 0 if there is none.
        self.shorter = [self._shorter(p) if p in normal else 0 for p in self.text]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}

    def _shorter(self, piece: str) -> int:
        for k in range(len(piece) - 1, 0, -1):
            if piece[:k] in self.ids:
                return self.ids[piece[:k]]
        return self.count + ord(piece[0]) if len(piece) > 1 else 0

    def merged(self, text: str) -> list[str]:
        """What merging the best adjacent pair, the leftmost of equal ones, again and again leaves. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _string(self, piece: int) -> str:
        """A piece's text; numbers from ``count`` on are characters without a piece."""
        return self.text[piece] if piece < self.count else chr(piece - self.count)

    def _compatible(self, left: int, right: int) -> bool:
        """True if merging both pieces' text gives the two pieces again; left is 0 at a text's start."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        parts = [self._string(p) for p in (left, right) if p]
        found = self.pairs[left << 32 | right] = self.merged("".join(parts)) == parts
        return found

    def split(self, text: str) -> list[int]:
        """The pieces of a text (not empty): ids, and ``count`` plus the code point for characters without a piece."""
        count, sizes, shorter, pairs = self.count, self.size, self.shorter, self.pairs
        end_of_text = len(text)
        longest = [0] * end_of_text
        for last_char, piece in self.automaton.iter(text):  # by end, so the longest of a start comes last
            longest[last_char + 1 - sizes[piece]] = piece
        failed = None
        path: list[int] = []
        at, left = 0, 0
        piece = longest[0] or count + ord(text[0])
        while True:
            while piece:
                end = at + (sizes[piece] if piece < count else 1)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(left << 32 | piece)
                    if fits or (fits is None and self._compatible(left, piece)):
                        break
                piece = shorter[piece] if piece < count else 0
            if piece:
                path.append(piece)
                if end == end_of_text:
                    return path
                at, left = end, piece
                piece = longest[at] or count + ord(text[at])
            else:
                if failed is None:
                    failed = bytearray((end_of_text >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                path.pop()
                at -= sizes[left] if left < count else 1
                piece, left = shorter[left] if left < count else 0, path[-1] if path else 0

    def _run_ids(self, run: str) -> tuple[int, ...]:
        """Ids of a run of characters that merges may join."""
        out: list[int] = []
        for piece in self.split(run):
            if piece < self.count:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(piece - self.count).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def _remember(self, word: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Keeps the ids of a word; where that is full, the ones kept before are let go."""
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known_before, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def run_ids(self, run: str) -> tuple[int, ...]:
        """Ids of a run of characters that merges may join."""
        found = self.known.get(run)
        if found is None:
            found = self._remember(run, self.known_before.get(run) or self._run_ids(run))
        return found

    def _windows(self, text: str) -> Iterator[str]:
        """A text in parts of about ``WINDOW`` characters, cut where no merge can cross."""
        begin = 0
        while begin < len(text):
            end = begin + WINDOW
            while end < len(text) and text[end - 1 : end + 1] in self.inside:
                end += 1
            yield text[begin:end]
            begin = end

    def _encode_windows(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part. All are cut into runs at once, and each distinct run is looked up once."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        of = self.classes[codes]
        cut = np.ones(len(codes) + 1, bool)
        np.logical_not(self.joins[of[:-1], of[1:]], out=cut[1:-1])
        part_ends = np.cumsum([len(p) for p in parts])
        cut[part_ends] = True
        at = np.flatnonzero(cut)
        places = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)])
        buffers = [None, pa.py_buffer(places[at].astype("<i4").tobytes()), pa.py_buffer("".join(parts).encode())]
        runs = pa.StringArray.from_buffers(len(at) - 1, buffers[1], buffers[2]).dictionary_encode()
        index = runs.indices.to_numpy()
        ids = pa.array([self.run_ids(r) for r in runs.dictionary.to_pylist()], pa.list_(pa.int32()))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy()[index])])[np.searchsorted(at, part_ends)]
        return np.split(ids.take(runs.indices).flatten().to_numpy(), ends[:-1])

    def encode_batch(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text; null counts as empty."""
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def settle() -> None:
            for (i, _), found in zip(waiting, self._encode_windows([w for _, w in waiting]), strict=True):
                ids[i].append(found)
            waiting.clear()

        size = 0
        for i, text in enumerate(texts):
            for window in self._windows(self.processor.normalize(text or "")):
                waiting.append((i, window))
                size += len(window)
                if size >= WINDOW:
                    settle()
                    size = 0
        if waiting:
            settle()
        ends = np.cumsum([0, *(sum(map(len, x)) for x in ids)])
        flat = [a for x in ids for a in x]
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return self.encode_batch([text])[0].as_py()


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows, so that little is held as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array of int, n_tokens long), one row for each row of ``docs``."""
    path = vocabulary or default_vocabulary()
    kind = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            ids = model(path).encode_batch(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(id_col), ids], names=[id_col, "ids"])

    out = map_batches(docs.select(id_col, text_col), run, schema)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, to: str = "decoded") -> DataFrame:
    """``df`` with ``to`` added: the text of its ids, as the library's decode gives it. Null ids give null."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in df.columns if c != to]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            of, column = processor(path).decode, b.column(ids_col)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            # one row's ids at a time as Python numbers, which take nine times their place
            rows = zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)
            text = [(of(values[i:j].tolist()) if j > i else "") if there else None for i, j, there in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, to])

    return map_batches(df.select(*keep), run, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    ids = encode(read(spark, sf_dir, "documents"))
    out = decode(ids.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

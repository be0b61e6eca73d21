"""Vector codes, SentencePiece encoding and phrase collocations against plain versions."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import codes, collocations, pieces, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_phrase_collocations"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name]).project(",".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect()) and want


# vector codes


def _plain_nearest(row, book):
    distances = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry)) for entry in book]
    return min(range(len(book)), key=lambda i: (distances[i], i)), min(distances)


@pytest.mark.parametrize("span", [3, 300, 1 << 20, 1 << 25, 1 << 40, 1 << 62])
def test_nearest_is_exact_with_ties(span):
    rng = np.random.default_rng(span % 1000)
    rows = rng.integers(-span, span, (200, 4))
    book = rng.integers(-span, span, (40, 4))
    book[20:] = book[:20] + rng.integers(-1, 2, (20, 4))
    rows[:50] = book[rng.integers(0, 40, 50)]
    index, distance = codes.nearest(rows, book)
    assert [(int(i), int(d)) for i, d in zip(index, distance)] == [_plain_nearest(r, book) for r in rows]


def test_intervals_hold_the_best_and_screen_most():
    rng = np.random.default_rng(5)
    rows, book = rng.integers(-4000, 4000, (500, 8)), rng.integers(-4000, 4000, (64, 8))
    may = codes.candidates(rows, book)
    assert all(may[i, _plain_nearest(r, book)[0]] for i, r in enumerate(rows)) and may.sum() < 2 * len(rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [i / 256 for i in range(32)]
    rows = [(3, one, 1, 9), (1, [-x for x in one], None, 9), (2, one, 1, 9), (2, one, 1, 9), (None, [1e30] * 32, None, 9), (5, None, 1, 9), (6, [*one[1:], None], 1, 9), (7, [*one[1:], nan], 1, 9), (8, [*one[1:], inf], 1, 9), (9, [1.0], 1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _s int")
    out, books = codes.compress(df.repartition(3))
    got = sorted(((r["vec_id"], r["label"], r["code"].hex(), r["error"]) for r in out.collect()), key=str)
    assert [g[0] for g in got] == [1, 2, 2, 3, None] and [g[3] for g in got] == [0, 0, 0, 0, 0]
    assert got[0][2] == "00" * 16 and got[1][2] == "01" * 16 == got[3][2] and got[4][2] == "04" * 16
    assert books[0][0] == [0, -1] and books[0][4][0] == 1 << 62
    near = spark.createDataFrame([(1, 5, 1), (2, 6, None), (3, 7, None), (4, None, 2), (5, 1, 2), (6, (1 << 62), 3), (7, (1 << 62), 3)], "vec_id long, error long, label int")
    sums = {r["vec_id"]: r["label_error"] for r in codes.with_label_errors(near).collect()}
    assert sums == {1: 5, 2: 13, 3: 13, 4: None, 5: None, 6: None, 7: None}
    back = codes.decompressed(out, books).filter("vec_id = 3").first()["restored"]
    assert back == one
    nothing, books = codes.compress(df.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "label", "code", "error"] and codes.digest_text(books) == ""


def test_a_round_moves_entries_to_floors_of_means(spark):
    rows = [(i, [x / 256] * 16) for i, x in enumerate([0, 10, -3, -4, 11, 0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = codes.codebooks(df, "vec_id", "embedding", parts=16, entries=2, rounds=1)
    assert books == [[[-2], [10]]] * 16  # floor(-7 / 4), floor(21 / 2)


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.default_vocabulary())


def test_every_document_as_the_library(spark, model):
    from hashlib import sha256

    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.queries()["op12_sentencepiece"](spark, DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = model.processor.encode(rows[r["doc_id"]], num_threads=1)
        text = model.processor.decode(ids) if ids else ""
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())


def test_strange_texts_as_the_library(model):
    rng = random.Random(3)
    signs = "  \n\t▁aehtinos.,é①日本語\U0001f600<s>0123 \0́ing"
    parts = list(model.ids)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += [" " * n for n in range(70)] + ["a" * 3000, "ab" * 2000, "日本" * 900, "the " * 2000, "".join(rng.choice(parts).replace("▁", "") for _ in range(3000)), "\U0001f600" * 500]
    assert model.encode_batch(texts).to_pylist() == [model.processor.encode(t) for t in texts]


def test_windows_and_memory_bounds_change_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 7)
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    texts = ["one two three, four  five six\nseven eight", None, "", "x" * 50, "aé日本 b"]
    assert model.encode_batch(texts).to_pylist() == [model.processor.encode(t or "") for t in texts]


def test_pieces_of_odd_rows(spark, model):
    rows = [(1, None, 5), (1, "", 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5), (3, "z" * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = pieces.decode(pieces.encode(df))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["decoded"]) for r in out.collect())
    ab = len(model.processor.encode("a b"))
    assert got == sorted([("1", 0, ""), ("1", 0, ""), ("None", ab, "a b"), ("2", ab, "a b"), ("2", ab, "a b"), ("3", len(model.processor.encode("z" * 100_000)), "z" * 100_000)])
    assert pieces.encode(df.limit(0)).count() == 0


# collocations


def _plain(rows, least, top):
    import re

    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1))
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        held = any(g[0] == lang and len(g) - 1 > len(w) and b >= a and any(list(g[s : s + len(w)]) == w for s in range(1, len(g) - len(w) + 1)) for g, b in found.items())
        if not held:
            cuts = [(1000 * a * totals[lang] // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, counts[lang, *w[:k]], counts[lang, *w[k:]], totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(best)]
    return sorted(ranked)


@pytest.mark.parametrize("shard, bits", [(3_000_000, 28), (23, 6)])
def test_phrases_against_a_plain_count(spark, monkeypatch, shard, bits):
    monkeypatch.setattr(collocations, "SLICE", 40)
    rng = random.Random(11)
    vocabulary = ["a", "b", "B", "né", "日", "it's", "x" * 90, "x\0y", "\xa0"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [("a a a a a a a a a", "en"), (None, "en"), ("", None), (". ,", "fr"), ("only once here", "und")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "text string, lang string, n int, phrase string").repartition(3)
    found = collocations.ranked(collocations.collocations(df, least=4, shard_words=shard, most_bits=max(bits, 16)), 7)
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _plain(rows, 4, 7) and got


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    ids = rng.integers(2, 5, 300)
    order = collocations.suffix_array(ids, 5)
    suffixes = [tuple(ids[i : i + 8]) for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(300))
    common = collocations.common_prefixes(ids, order, 5)
    for k in range(1, 300):
        a, b = ids[order[k - 1] :][:5], ids[order[k] :][:5]
        want = next((i for i in range(5) if i >= min(len(a), len(b)) or a[i] != b[i]), 5)
        assert common[k] == want


def test_exact_scores_beyond_64_bits(spark):
    levels = [spark.createDataFrame([("en", None, 10**15), ("en", "p", 10**14), ("en", "q", 3 * 10**14)], "lang string, phrase string, n long"), spark.createDataFrame([("en", "p q", 10**14)], "lang string, phrase string, n long")]
    collocations_of = collocations.frequent_phrases
    try:
        collocations.frequent_phrases = lambda *a: levels
        (row,) = collocations.collocations(levels[0]).collect()
    finally:
        collocations.frequent_phrases = collocations_of
    assert row["score"] == 1000 * 10**14 * 10**15 // (10**14 * 3 * 10**14)

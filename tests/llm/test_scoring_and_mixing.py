"""Lattice likelihood, source mixing, and the pipeline."""

import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lm, mixing
from graphloom.sources.tables import shared_dir

DIR = "/root/testdata/sf0.001"


def test_lattice_sums_over_all_spellings():
    path = lm.default_vocabulary()
    t = lm.trie(path)
    text, _ = lm._pieces(path)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (2, t.n + 1)).astype(float)
    lattice = lm.Lattice(path, counts, np.array([100.0, 0.0]))

    def node(root, s):
        for b in s:
            root = t.table[t.row[root], b]
        return root

    starts = {p[len(lm.MARK) :]: node(0, p[len(lm.MARK) :]) for p in text if p is not None and p.startswith(lm.MARK)}
    inner = {p: node(1, p) for p in text if p is not None and not p.startswith(lm.MARK)}
    words = [b"the", b"x", "\u00e9".encode(), b"\x00a", b"inging", b"the"]
    got = lattice.log_probabilities(words)
    used = np.zeros_like(counts)
    for word, row in zip(words, got, strict=True):
        for k in range(2):
            sums = [0.0] * (len(word) + 1)
            for j in range(len(word) + 1):
                sums[j] += math.exp(lattice.log[k, starts[word[:j]]]) if word[:j] in starts else 0.0
                for i in range(j):
                    sums[j] += sums[i] * math.exp(lattice.log[k, inner[word[i:j]]]) if word[i:j] in inner else 0.0
            assert math.isclose(row[k], math.log(sums[-1]) + lattice.end[k], rel_tol=1e-9)
            # Expected counts: each arc's share of the sum over all spellings through it.
            after = [0.0] * len(word) + [1.0]
            for i in range(len(word) - 1, -1, -1):
                after[i] = sum(math.exp(lattice.log[k, inner[word[i:j]]]) * after[j] for j in range(i + 1, len(word) + 1) if word[i:j] in inner)
            for j in range(len(word) + 1):
                if word[:j] in starts:
                    used[k, starts[word[:j]]] += math.exp(lattice.log[k, starts[word[:j]]]) * after[j] / sums[-1]
                for i in range(j):
                    if word[i:j] in inner:
                        used[k, inner[word[i:j]]] += sums[i] * math.exp(lattice.log[k, inner[word[i:j]]]) * after[j] / sums[-1]
    assert np.allclose(lattice.expected(words, np.ones((len(words), 2))), used, atol=1e-9)
    for k in range(2):
        assert math.isclose(np.exp(lattice.log[k][t.starts]).sum(), 1.0, rel_tol=1e-9)
        assert math.isclose(np.exp(lattice.log[k][~t.starts]).sum() + math.exp(lattice.end[k]), 1.0, rel_tol=1e-9)
    assert np.isfinite(lattice.log_probabilities([b"q" * 5_000])).all()


def test_learning_makes_training_words_likelier(spark):
    docs = spark.createDataFrame([("the cat sat on the mat " * 3, 0), ("catmat thecat matsat", 0), ("der hund sass", 1), (None, None)], "text string, class int")
    counts = lm.materialise(lm.count_words(docs, 2), "w")
    before = None
    for rounds in range(4):
        lattice = lm.learn(counts, lm.default_vocabulary(), np.array([8.0, 3.0]), rounds)
        now = lattice.log_probabilities([b"the", b"cat", b"sat", b"on", b"mat", b"catmat", b"thecat", b"matsat"])[:, 0].sum()
        assert before is None or now > before
        before = now


def base_scores(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in [*lm.words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (len(lm.words_of(t)) + 1, sum(counts[w] > 0 for w in [*lm.words_of(t), None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*lm.words_of(t), None])) for i, t in rows}


@pytest.mark.parametrize("frequent", [1 << 19, 4])
def test_scores_of_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(1, "The cat the CAT É"), (2, None), (3, ""), (4, "unseen wörds \x0b here"), (5, "the cat"), (5, "the cat"), (None, "the"), (7, "x" * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS class", "3 AS held_out")
    got = lm.score(df, F.coalesce(F.col("doc_id") == 4, F.lit(False))).collect()
    want = base_scores(rows, lambda i: i == 4)
    assert len(got) == len(rows)
    by: dict = {}
    for i, t in rows:
        by.setdefault(i, []).append(want[i, t])
    for r in got:
        n_tokens, n_known, n, base = by[r["doc_id"]].pop()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"] + r["lattice_score"])
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
    nothing = lm.score(df, F.lit(True)).collect()
    assert {r["base_score"] for r in nothing} == {0.0} and all(math.isfinite(r["score"]) for r in nothing)


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 1.02), ("sf0.1", 1.0)])
def test_scores_of_held_out_rows(spark, sf, least):
    """Base scores are exact; the model's sum is higher at sf0.1, and at sf0.01 within a fiftieth of it: there a sixth of the words are
    new, and the base gives each new word as much as a word may have, however many there could be, while spellings share one unit.
    """
    got = lm.op3_lattice_lm(spark, f"/root/testdata/{sf}")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    want = base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    text = dict(rows)
    held = [r for r in got.collect() if r["held_out"]]
    for r in held:
        n_tokens, n_known, n, base = want[r["doc_id"], text[r["doc_id"]]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert sum(r["score"] for r in held) > least * sum(r["base_score"] for r in held)
    assert all(r["lattice_score"] < 0 and math.isfinite(r["lattice_score"]) for r in held)


def test_tables_stored_on_the_way_are_smaller_than_the_input(spark, monkeypatch):
    """Scores of all words would outweigh the texts. Looked up in place or joined, words have the same scores."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    stored = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = stored()
    want = {r["doc_id"]: r for r in lm.op3_lattice_lm(spark, "/root/testdata/sf0.01").collect()}
    assert 0 < stored() - before < Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    monkeypatch.setattr(lm, "FREQUENT", 4)
    got = lm.op3_lattice_lm(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        assert all(math.isclose(r[name], want[r["doc_id"]][name], rel_tol=1e-9) for name in ("base_score", "score", "lattice_score"))


def water(sizes):
    """Targets by pouring out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    free = set(names)
    while free:
        left = total - sum(target.values())
        all_weight = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / all_weight > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / all_weight for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_gives_each_source_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, "hot" if i % 3 else ("b", None, "ä", "z" * 5)[i % 4], "w " * (i % 23)) for i in range(300)]
    rows += [(7, "hot", "w " * 500), (7, "hot", "w " * 500), (None, None, None), (5, "empty", ""), (6, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS rank", "3 AS target")
    sized = mixing.sized(df)
    goals = mixing.materialise(mixing.targets(sized), "t")
    sizes: Counter = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    got = {r["source"]: r["target"] for r in goals.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
    plan = mixing.mix(sized, goals, block_words=4).join(sized, "_row").collect()
    taken: Counter = Counter()
    per_row: Counter = Counter()
    for r in plan:
        taken[r["source"]] += r["to_word"] - r["from_word"]
        per_row[r["_row"]] += r["to_word"] - r["from_word"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert all(per_row[r["_row"]] <= 2 * r["size"] for r in plan)
    again = mixing.mix(sized, goals, block_words=4).collect()
    key = lambda r: (r["slot"], r["_row"], r["pass"], r["from_word"], r["to_word"])
    assert sorted(map(key, again)) == sorted(map(key, plan))
    # Any stretch of the mix holds the sources in about their shares.
    slots = sorted({(r["slot"], r["source"]) for r in plan}, key=str)
    first = [s for k, s in sorted(slots, key=lambda x: x[0])[:400]]
    total = sum(want.values())
    for s in want:
        assert abs(first.count(s) / len(first) - want[s] / total) < 0.05


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    sized = mixing.sized(df)
    assert mixing.mix(sized, mixing.targets(sized)).count() == 0


def test_mix_query_matches_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert sorted(map(tuple, mixing.op10_mix_sources(spark, DIR).collect())) == sorted(duckdb.sql(mixing.OP10_SQL).fetchall())


def test_mix_query_of_odd_words_matches_sql(spark, tmp_path):
    """White space of all kinds, one word after another longer than a slot, a source without words, ties."""
    texts = ["a\rb\vc\fd", "", None, " x\u00a0y \u2003z\r", "\x1c\x1d a", "w " * 40_000, "v\t" * 700, "tie tie", "tie tie"]
    rows = [(i, t, ("s", None, "hot", "hot")[i % 4]) for i, t in enumerate(texts * 9)] + [(3, "same same", "hot")] * 3 + [(900, None, "void")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, mixing.op10_mix_sources(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.OP10_SQL).fetchall()
    assert len(want) == len(rows) and {r[1] for r in got} >= {4, 0, 2, 40_000, 700}
    # Equal rows (the same id, text and source) may change places among themselves.
    assert got == sorted(want, key=str)
    assert len({r[5] for r in got}) > 10


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from graphloom.llm import secrets

    line = "the quick brown fox jumps over the lazy dog while {} other animals of the wood look on in wonder and say nothing at all {}."
    rows = [(i, line.format(i, i * 7) + f"\nand so it goes on for {i} days and nights.", "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s0", 0), (100, rows[0][1], "en", "s0", 0), (101, None, None, None, None), (102, "", "en", "s1", 0), (103, "too short", "en", "s1", 0)]
    rows += [(None, line.format("many", "x") + " password = 'Zx9kQ2mB7vL4pR8t01'", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS kept", "2 AS spans", "3 AS _row")
    out = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, DIR), name)
        out[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == list(pipeline.COLUMNS)
    assert sorted(str(r["doc_id"]) for r in out["quality_rules"]) == sorted([*map(str, range(30)), "100", "100", "None"])
    assert sorted(str(r["doc_id"]) for r in out["ngram_jaccard"]) == sorted([*map(str, range(30)), "None"])
    assert not any(secrets.ASSIGN.search(r["text"]) for r in out["secret_scan"]) and any("[SECRET]" in r["text"] for r in out["secret_scan"])
    words = lambda rs: sum(len(r["text"].split()) for r in rs)
    whole = {r["text"] for r in out["secret_scan"]}
    cut = [r["text"] for r in out["mix_sources"] if r["text"] not in whole]
    assert len(cut) <= 5 and all(any(w.startswith(t) for w in whole) for t in cut)
    assert abs(words(out["mix_sources"]) - 1.5 * words(out["secret_scan"])) < 5
    assert all(r["n_tokens"] > 0 for r in out["byte_bpe"]) and len(out["byte_bpe"]) == len(out["mix_sources"])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        empty = pipeline.materialise(stage(spark, empty, DIR), name)
        assert empty.count() == 0

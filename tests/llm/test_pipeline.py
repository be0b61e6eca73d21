"""The whole pipeline over a table, against what its stages must keep."""

from itertools import combinations

import duckdb
import numpy as np

import corpus_pipeline as pipeline
from graphloom.llm import bpe, mixing, quality, secrets

DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_run_against_plain_reading(spark):
    got = pipeline.run(spark, DIR).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    documents = {i: (t, s) for i, t, s in con.sql("SELECT doc_id, text, source FROM documents").fetchall()}
    kept = {r[0] for r in con.sql(quality.OP5_SQL).project("doc_id, kept").fetchall() if r[1]}
    clean = {r["doc_id"]: r["clean_text"] for r in quality.clean(spark.read.parquet(f"{DIR}/documents.parquet")).filter("kept").collect()}
    assert set(clean) == kept
    # Of each group of near copies the least id stays.
    least, sets = {i: i for i in kept}, {i: shingles(clean[i]) for i in kept}
    def find(i):
        while least[i] != i:
            i = least[i]
        return i
    for a, b in combinations(sorted(kept), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    alone = {i for i in kept if find(i) == i}
    safe = {i: secrets.redacted(clean[i], "[SECRET]") for i in alone}
    assert not any(kind != "lexed" for t in safe.values() for kind, *_ in secrets.spans(t))

    vocabulary = bpe._byte_table(bpe.default_vocabulary())
    used: dict = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["n_tokens"]
        used.setdefault(r["doc_id"], []).append(b"".join(vocabulary[i] for i in ids).decode())
    sizes: dict = {}
    for i in alone:
        sizes[documents[i][1]] = sizes.get(documents[i][1], 0) + len(safe[i].split())
    assert set(used) <= alone
    taken: dict = {}
    for i, texts in used.items():
        assert len(texts) <= mixing.MOST and all(safe[i].startswith(t) for t in texts)
        taken[documents[i][1]] = taken.get(documents[i][1], 0) + sum(len(t.split()) for t in texts)
    # Most uses are whole; a source has one that is cut.
    assert sum(t != safe[i] for i, texts in used.items() for t in texts) <= len(sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(taken.get(s, 0) <= 2 * n + 1 for s, n in sizes.items())


def test_long_texts_pass_all_stages(spark):
    long = " ".join(f"word{i % 4_001}x{i}" for i in range(60_000)) + ".\n" + "password = 'Zx9kQ2mB7vL4pR8t01'\n" + " ".join(f"more{i}" for i in range(300))
    rows = [(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(50)), "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, DIR), name)
    got = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert set(got) == {1, 3} and got[1] > 60_000

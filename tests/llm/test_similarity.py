"""The Jaccard join, embedding near-dedup, and components."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from graphloom.llm import jaccard, neighbours
from graphloom.llm.components import components, id_of, named

DIR = "/root/testdata/sf0.001"


def joined(n, links):
    """Least member of each item's component."""
    least = list(range(n))
    def find(i):
        while least[i] != i:
            least[i] = least[least[i]]
            i = least[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 200)
    links = [(a, b) for a, b in zip(names, names[1:120])] + [(a, b) for a, b in zip(names[120:], names[121:])] + [(5_000_000, 5_000_000), (names[0], names[5])]
    df = spark.createDataFrame(links + links[:9] + [(b, a) for a, b in links[:9]], "u long, v long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {x: (min(names[:120]) if i < 120 else min(names[120:])) for i, x in enumerate(names)}
    assert components(df.limit(0)).count() == 0


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_copies(rng):
    base = [f"w{rng.randrange(5_000)}" for _ in range(120)]
    out = []
    for k in range(40):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9_999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1_024, 8])
def test_jaccard_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ITEMS", block)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3_000)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", " \n ", "one two", "one  two", "two one", *near_copies(rng), *[" ".join(rng.choices(words, k=50)) + " " + passage for _ in range(12)], *["same text here again and again"] * 30]
    texts += ["word " * 3_000, "word " * 2_999]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bands", "3 AS group")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    degree = [0] * len(texts)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar(df).collect())
    assert got == [(i, c, degree[i]) for i, c in enumerate(joined(len(texts), links))]


def test_jaccard_with_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(None, a), (None, a), (3, a), (3, b), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar(df).collect()), key=str)
    assert got == sorted([(None, 3, 2), (None, 3, 2), (3, 3, 2), (3, 3, 0), (3, 3, 0)], key=str)
    assert jaccard.similar(df.limit(0)).count() == 0


def test_names_sort_as_ids(spark):
    from pyspark.sql import functions as F

    for kind, ids in (("long", [-(2**63), -10, -9, 0, 7, 10, 2**63 - 1]), ("int", [-3, 20, 100]), ("string", ["", "a", "a0", "b"])):
        df = spark.createDataFrame([(i, f"{k:02d}") for k, i in enumerate([*ids, None])], f"i {kind}, d string")
        named_ = df.withColumn("name", named(F.col("i"), df.schema["i"].dataType, F.col("d")))
        got = [r[0] for r in named_.orderBy("name").select(id_of(F.col("name"), df.schema["i"].dataType, 2)).collect()]
        assert got == [*ids, None]
    rows = [("b", "w " * 9), ("a", "w " * 9), ("c", " ".join("abcdefghijkl"))]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard.MOST_PERMUTATIONS


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    text = ("ab  cd\n" * 100 + "x" * 5_000 + " yy").encode()
    whole = jaccard.word_hashes(text)
    assert len(whole) == 202 and len(set(whole.tolist())) == 4
    counts = jaccard.common_counts([np.arange(i, i + 50, dtype=np.uint64) for i in range(80)], *map(np.array, zip(*combinations(range(80), 2), strict=True)))
    assert counts.tolist() == [max(0, 50 - (b - a)) for a, b in combinations(range(80), 2)]


def test_jaccard_query_matches_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert sorted(map(tuple, jaccard.op9_ngram_jaccard(spark, DIR).collect())) == sorted(duckdb.sql(jaccard.OP9_SQL).fetchall())


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ITEMS", 16)
    rng = np.random.default_rng(2)
    rows, d = [], 40
    for label in (0, 1, None):
        centres = rng.normal(size=(4, d))
        for k in range(60):
            v = centres[k % 4] + rng.normal(size=d) * (0.02 + 0.5 * (k % 3))
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    hot = rng.normal(size=d).astype(np.float32).tolist()
    rows += [(len(rows) + i, hot, 1) for i in range(30)]
    odd = [None, [], [0.0] * d, [1.0, None], [float("nan")] * d, [float("inf")] * d, [1.0, 2.0], [2.0, 4.0], [3e38] * d, [1e-40] * d]
    rows += [(len(rows) + i, v, 0) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS n", "3 AS copies")
    ok = lambda v, label: label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    units = {i: (label, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))) for i, v, label in rows if ok(v, label)}
    links = [(a, b) for a, b in combinations(units, 2) if units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= 0.93]
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = [(i, degree[i], c, i == c) for i, c in enumerate(joined(len(rows), links))]
    assert sorted(map(tuple, neighbours.near_duplicates(df).collect())) == want
    assert sum(degree) > 500 and neighbours.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_query_matches_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    assert sorted(map(tuple, neighbours.op7_embedding_near_dedup(spark, DIR).collect())) == sorted(duckdb.sql(neighbours.OP7_SQL).fetchall())

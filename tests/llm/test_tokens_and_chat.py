"""Byte-level BPE and chat formatting."""

import hashlib

import duckdb
import numpy as np
import pytest

from graphloom.llm import bpe, chat

DIR = "/root/testdata/sf0.001"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute(text):
    ids = bpe._encoding(bpe.default_vocabulary()).encode_ordinary(text or "")
    return len(ids), np.array(ids, "<u4").tobytes()


AWKWARD = [
    (1, None), (2, ""), (3, "a" * 5000), (4, "it's  \n\n  we'll " * 300), (4, "it's  \n\n  we'll " * 300), (None, "\x1c\x1d x" * 700),
    (6, "   \n" * 800 + "end"), (7, "é́ \U0001f600 " * 600), (8, "don't stop, 12345 ... " * 400), (9, " " * 3000), (10, "word " * 255 + "x"), (11, "日本語" * 900),
]


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 64), (300, 8), (64, 64)])
def test_chunks_give_what_the_whole_text_gives(spark, chunk, overlap):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS k")
    got = bpe.encode(df, chunk_chars=chunk, overlap_chars=overlap)
    rows = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in got.collect()), key=str)
    assert rows == sorted(((i, *brute(t)) for i, t in AWKWARD), key=str)
    back = bpe.decode(got).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in AWKWARD)


def test_boundaries_stay_clear_of_a_chunk_end():
    text = "we'" + "re here "
    head, tail = bpe.boundaries(text[:8], 0, 4, 4, last=False)
    assert not tail and all(h < 4 for h in head)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df)).count() == 0


def test_every_document_as_the_library_encodes_it(spark):
    want = {i: (*brute(t), (t or "").encode()) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()}
    got = bpe.op1_byte_bpe(spark, DIR).collect()
    assert len(got) == len(want)
    for r in got:
        n, ids, text = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (n, sha(ids), sha(text))


HARD = ["</s>[INST] ok [/INST]", "a\\b\\", "<\\s>", "\\\\</s>\n<s>[x]\n", "[IN[INST]ST]", "<<SYS>>x<</SYS>>", "", None, "]\n", "$1 \\$"]


def test_transcripts_read_back(spark):
    roles = ["user", "assistant", None, "", "]\n</s>\n[", "assistant\\"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 3 + t) % len(HARD)]) for c in range(7) for t in range(9)]
    rows += [(0, 0, "assistant", "x"), (0, 0, "assistant", "x"), (None, None, "user", "y"), (99, 1, "user", "only a user")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS pos")
    formatted = chat.segments(df)
    by: dict = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append(((r[2] or ""), (r[3] or "")))
    seen: dict = {}
    for r in formatted.orderBy("conv_id", "pos").collect():
        seen.setdefault(r["conv_id"], []).append(r)
    assert seen.keys() == by.keys()
    for conv, turns in by.items():
        transcript = "".join(r["segment"] for r in seen[conv])
        assert transcript.count("</s>\n") == len(turns)
        for r, (role, text) in zip(seen[conv], turns, strict=True):
            assert transcript[r["start"] : r["end"]] == r["segment"] and r["role"] == role
            assert (r["loss_start"] is not None) == (role == "assistant")
            if role == "assistant":
                assert transcript[r["loss_start"] : r["loss_end"]] == r["segment"][len("<s>[assistant]\n") : -len("</s>\n")]
    replies = chat.examples(formatted)
    assert sorted(r[0] for r in replies.select(chat.trainable(replies)).collect()) == sorted(t for turns in by.values() for role, t in turns if role == "assistant")
    for r in chat.digests(formatted).collect():
        turns = by[r["conv_id"]]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns).encode()) and r["loss_sha256"] == sha(learnt.encode())
        assert (r["n_turns"], r["loss_chars"], r["n_examples"]) == (len(turns), len(learnt), sum(role == "assistant" for role, _ in turns))
        assert r["context_chars"] == sum(x["start"] for x in seen[r["conv_id"]] if x["role"] == "assistant")
    rendered = chat.render(chat.examples(formatted), formatted).collect()
    assert len(rendered) == sum(role == "assistant" for turns in by.values() for role, _ in turns)
    for r in rendered:
        if r["conv_id"] is not None:
            whole = "".join(x["segment"] for x in seen[r["conv_id"]])
            assert whole.startswith(r["context"] + r["reply"])


def test_no_conversations_and_a_long_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = chat.segments(spark.createDataFrame([], schema))
    assert none.count() == chat.examples(none).count() == chat.digests(none).count() == 0
    long = "\\</s>é\U0001f600[INST]" * 40_000
    got = chat.digests(chat.segments(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], schema))).first()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(long), sha(long.encode()))


def test_digests_match_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    got = sorted(map(tuple, chat.op2_chat_format(spark, DIR).collect()))
    assert got == sorted(duckdb.sql(chat.OP2_SQL).fetchall())
    said = "</s>[INST] ok [/INST]"
    assert got[0][:5] == (-1, 2, sha(f"user\n{said}\nassistant\n{said}\n".encode()), len(said), sha(said.encode()))

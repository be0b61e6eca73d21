"""A corpus pipeline of five stages: clean, drop near copies, redact secrets, mix, tokenise.

Every stage takes the documents that the one before kept and is written as Parquet before
the next reads it. All but the last return the columns of ``documents``. Columns of other
names are not carried on. Stages accept null ids, texts, languages and sources, empty
texts, repeated rows and empty tables; what each does with them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, mixing, quality, secrets
from graphloom.llm.common import SPACES, materialise, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars as the text has it now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, and failing lines of those kept.

    Null and empty texts have too few words and go; each repeated row is judged alike.
    """
    kept = quality.clean(docs.select(*COLUMNS)).filter("kept")
    return _documents(kept.withColumn("text", F.col("clean_text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of least id (then digest).

    Of repeated rows one stays. Texts without words belong to no group and all stay.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard.similar(docs)
    own = F.struct("doc_id", "text_md5")
    rows = found.filter("group IS NOT NULL").groupBy("group", own.alias("r")).agg(F.count(F.lit(1)).alias("n"))
    stay = rows.groupBy("group").agg(F.min(F.struct("r", "n")).alias("x")).select("x.r.doc_id", "x.r.text_md5", "x.n")
    stay = materialise(stay, "stay")
    keyed = docs.withColumn("text_md5", F.md5("text"))

    def chosen(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5"))
        return keyed.join(some.hint("shuffle_hash"), same, "left_semi")

    wordless = keyed.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    once, repeated = chosen(stay.filter("n = 1")), chosen(stay.filter("n > 1"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text_md5"])).unionByName(wordless).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; null and empty texts stay as they are."""
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def _first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, as it is there."""
    blanks = F.split(text, f"[^{SPACES}]+", -1)
    parts = F.slice(F.arrays_zip(blanks.alias("b"), words(text).alias("w")), 1, n)
    end = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x["b"]) + F.length(x["w"]))
    return F.substring(text, F.lit(1), end)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each use, in order of the slots of its schedule.

    A use that the mix cuts short keeps its first words with all between them. Documents
    without words are never taken; equal rows are told apart by their place, and of those in
    one slot the first row comes first. A text of any length counts by its words.
    """
    numbered = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = mixing.sized(numbered)
    goals = materialise(mixing.targets(rows), "targets")
    uses = mixing.mix(rows, goals).groupBy("_row", "pass").agg(F.max("to_word").alias("_to"), F.min("slot").alias("_slot"))
    uses = uses.join(rows.select("_row", "size"), "_row")
    uses = uses.select("_row", "_slot", "pass", F.when(F.col("_to") < F.col("size"), F.col("_to").cast("int")).alias("_cut"))
    taken = numbered.join(uses.hint("shuffle_hash"), "_row").orderBy("_slot", "pass", "_row")
    return _documents(taken.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(_first_words(F.col("text"), F.col("_cut")))))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document; a null text has no tokens."""
    return bpe.encode(docs.select(*COLUMNS)).select("doc_id", "n_tokens", "ids")


#: (name, function); a function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenise),
]

#: MinHash, the lexer and the tokenizer have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

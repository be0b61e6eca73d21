"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each turn becomes a segment of its conversation's transcript::

    <s>[role]\\ntext</s>\\n

Control strings in a text get a backslash after their first character, and backslashes are
doubled, so a segment reads back to exactly its role and text.

Every assistant turn becomes one example: its context is the transcript before it
(all preceding turns) and its loss mask covers its reply alone. An example holds its reply
and gives its context by places in the transcript, so the output grows with the turns, not
with the square of a conversation's length; ``render`` writes chosen examples out as text.

Defined cases: a null text is empty and a null role is the empty role; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have a fixed order and all stay;
rows with a null conversation id form one conversation; an empty table gives no segments and
no examples; texts of any length are formatted whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read

#: Strings that no text may hold unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINABLE = "assistant"
OPEN, HEADER_END, CLOSE = "<s>[", "]\n", "</s>\n"
#: A segment without its close: group 1 is the escaped role, group 2 the escaped text.
SEGMENT = r"\A<s>\[((?:[^\\\]]|\\[\s\S])*+)\]\n([\s\S]*)\z"


def escape(text: Column) -> Column:
    """``text`` with backslashes doubled and control strings broken by one backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in sorted(CONTROLS, key=len, reverse=True):
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def escape_role(role: Column) -> Column:
    """``role`` escaped as a text, with a backslash before every closing bracket too."""
    return F.replace(escape(role), F.lit("]"), F.lit("\\]"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` and ``escape_role``."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row a turn: conv_id, pos (place in the conversation, from 1), role, segment,
    start and end (code points in the transcript), loss_start and loss_end (null unless trainable).
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(HEADER_END))
    size = F.length("segment").cast("long")
    loss = F.col("role") == TRAINABLE
    # Turns are shuffled as they are; what is longer, their segments, is made after it.
    return (
        rows.withColumn("pos", F.row_number().over(order).cast("long"))
        .withColumn("role", F.coalesce("_role", F.lit("")))
        .withColumn("_before", before)
        .withColumn("segment", F.concat("_before", escape(F.coalesce("_text", F.lit(""))), F.lit(CLOSE)))
        .withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long"))
        .withColumn("end", F.col("start") + size)
        .withColumn("loss_start", F.when(loss, F.col("start") + F.length("_before")))
        .withColumn("loss_end", F.when(loss, F.col("end") - len(CLOSE)))
        .drop("_turn", "_role", "_text", "_before")
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: its context is [0, context_end) of the transcript, all
    turns before; ``reply`` is [context_end, example_end), and [loss_start, loss_end) is trainable.
    """
    return formatted.filter(F.col("loss_start").isNotNull()).select(
        "conv_id",
        F.col("pos").alias("target_pos"),
        F.col("start").alias("context_end"),
        F.col("end").alias("example_end"),
        "loss_start",
        "loss_end",
        F.col("segment").alias("reply"),
    )


def trainable(example: DataFrame) -> Column:
    """The text under an example's loss mask, as it was before escaping."""
    start, size = example["loss_start"] - example["context_end"], example["loss_end"] - example["loss_start"]
    return unescape(F.substring(example["reply"], (start + 1).cast("int"), size.cast("int")))


def render(chosen: DataFrame, formatted: DataFrame) -> DataFrame:
    """(conv_id, target_pos, context, reply): the texts of the chosen examples.

    An example holds its whole context, so choose as many as the output may hold.
    """
    turns = formatted.select("conv_id", "pos", "segment")
    pairs = chosen.select("conv_id", "target_pos").join(turns, "conv_id").filter("pos <= target_pos")
    text = F.collect_list(F.struct("pos", "segment"))
    got = pairs.groupBy("conv_id", "target_pos").agg(F.array_sort(text).alias("_s"))
    is_reply = F.col("_s.segment")
    return got.select(
        "conv_id",
        "target_pos",
        F.array_join(F.slice(is_reply, 1, F.size("_s") - 1), "").alias("context"),
        F.element_at(is_reply, -1).alias("reply"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation: of its turns, read back from the transcript, and of what its examples train on."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    return digests(segments(turns.unionByName(extra)))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation of ``segments``: what its transcript and its examples say."""
    whole = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("_s"))
    whole = whole.select("conv_id", F.array_join("_s.segment", "").alias("_t"))
    cut = F.split("_t", CLOSE, -1)
    whole = whole.withColumn("_turns", F.slice(cut, 1, F.size(cut) - 1))
    back = F.transform(
        "_turns",
        lambda s: F.concat(
            unescape(F.regexp_extract(s, SEGMENT, 1)), F.lit("\n"), unescape(F.regexp_extract(s, SEGMENT, 2)), F.lit("\n")
        ),
    )
    expanded = examples(formatted)
    expanded = expanded.select("conv_id", "context_end", F.struct("target_pos", trainable(expanded).alias("text")).alias("_x"))
    learnt = expanded.groupBy(F.col("conv_id").alias("_id")).agg(
        F.array_sort(F.collect_list("_x")).alias("_x"), F.sum("context_end").alias("_context"), F.count(F.lit(1)).alias("_n")
    )
    masked = F.coalesce(F.array_join("_x.text", ""), F.lit(""))
    both = whole.join(learnt, F.col("conv_id").eqNullSafe(F.col("_id")), "left").withColumn("_masked", masked)
    return both.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"),
        F.sha2("_masked", 256).alias("loss_sha256"),
        F.length("_t").cast("long").alias("formatted_chars"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce("_context", F.lit(0)).cast("long").alias("context_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<</SYS>>', '<\</SYS>>'), '<<SYS>>', '<\<SYS>>'),
    '[/INST]', '[\/INST]'), '[INST]', '[\INST]'), '</s>', '<\/s>'), '<s>', '<\s>') AS esc,
    replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<</SYS>>', '<\</SYS>>'), '<<SYS>>', '<\<SYS>>'),
    '[/INST]', '[\/INST]'), '[INST]', '[\INST]'), '</s>', '<\/s>'), '<s>', '<\s>'), ']', '\]') AS esc_role FROM t),
f AS (
  SELECT *, sum(length(esc) + length(esc_role) + 11) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + length(esc_role) + 11)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples, coalesce(sum(before) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM f GROUP BY conv_id
"""

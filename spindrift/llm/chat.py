"""Conversations as one training text each, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

START, END = "<|im_start|>", "<|im_end|>"


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, roles, formatted) for each conversation.

    Turns are sorted by number, then role, then text, so ties and repeated rows have one order; a null number comes
    first. Neighbours of the same role become one message, their texts on lines of their own. A null role counts as
    "unknown", a null text as empty. Marks that look like the template's own, in a text or role, are broken up with a
    space. Rows without conv_id belong to no conversation and are left out; an empty table gives an empty result; other
    columns are ignored. The messages' roles are joined with ">" in roles.

    One shuffle, by conv_id. Every piece depends on its own turn and the one before it, so a conversation of any length
    is joined in one pass."""
    clean = lambda c, absent: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(absent)), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").alias("turn"), clean("role", "unknown").alias("role"), clean("text", "").alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("s"))
    before = lambda i: F.get(F.col("s"), i - 1)["role"]
    opens = lambda x, i: ~F.coalesce(before(i) == x["role"], F.lit(False))
    head = lambda x, i: F.concat(F.when(i > 0, f"{END}\n").otherwise(""), F.lit(START), x["role"], F.lit("\n"))
    pieces = F.transform("s", lambda x, i: F.concat(F.when(opens(x, i), head(x, i)).otherwise("\n"), x["text"]))
    first = F.filter(F.transform("s", lambda x, i: F.struct(opens(x, i).alias("o"), x["role"].alias("role"))), lambda x: x["o"])
    return sorted_turns.select(
        "conv_id",
        F.size("s").cast("long").alias("n_turns"),
        F.size(first).cast("long").alias("n_messages"),
        F.array_join(F.transform(first, lambda x: x["role"]), ">").alias("roles"),
        F.concat(F.array_join(pieces, ""), F.lit(f"{END}\n")).alias("formatted"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') AS role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role THEN 1 ELSE 0 END)
            OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS msg FROM n),
g AS (
  SELECT conv_id, msg, min(role) AS role, count(*) AS k, string_agg(text, chr(10) ORDER BY i) AS body
  FROM m GROUP BY conv_id, msg)
SELECT conv_id, CAST(sum(k) AS BIGINT) AS n_turns, count(*) AS n_messages,
       string_agg(role, '>' ORDER BY msg) AS roles,
       string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY msg) AS formatted
FROM g GROUP BY conv_id
"""

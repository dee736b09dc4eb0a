"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are
merged and the whole is concatenated: one aggregation, no Python, work linear in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import table

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_messages, chat.

    Turns go by (turn, role, text); a null turn comes first. Equal and repeated rows all stay.
    A null role is the role "unknown", a null text is empty, rows with a null conv_id form a
    conversation of their own. Merged turns are joined by a line break. Other columns are
    ignored; an empty table gives an empty result.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(x, i):
        joined = F.concat(F.lit("\n"), x["text"])
        opened = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), x["role"], F.lit(MIDDLE), x["text"])
        before = F.get(F.col("ts"), i - 1)["role"]
        return F.when((i > 0) & (before == x["role"]), joined).otherwise(opened)

    merged = F.aggregate(
        F.col("ts"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("role")),
        lambda s, x: F.struct((s["n"] + F.when(s["role"] == x["role"], 0).otherwise(1)).alias("n"), x["role"].alias("role")),
        lambda s: s["n"],
    )
    return chats.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        merged.alias("n_messages"),
        F.concat(F.array_join(F.transform("ts", piece), ""), F.lit(END)).alias("chat"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM n)
SELECT conv_id, count(*) AS n_turns,
       CAST(sum(CASE WHEN before = role THEN 0 ELSE 1 END) AS BIGINT) AS n_messages,
       string_agg(CASE WHEN before = role THEN chr(10) || text
                       ELSE (CASE WHEN k = 1 THEN '' ELSE '<|end|>' || chr(10) END) || '<|' || role || '|>' || chr(10) || text END, '' ORDER BY k)
         || '<|end|>' || chr(10) AS chat
FROM l GROUP BY conv_id
"""

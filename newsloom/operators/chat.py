"""Conversation transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import chat_role

# ---- fixed values ------------------------------------------------------------------------------
LINE_SEP = "\n"
TURNS_PER_CHUNK = 256
# -------------------------------------------------------------------------------------------------


def transcript_lines(messages: DataFrame) -> DataFrame:
    """``role: content`` per message, roles mapped to assistant/user."""
    return messages.select("conv_id", "turn", F.concat(chat_role("role"), F.lit(": "), F.col("text")).alias("line"))


def transcripts(messages: DataFrame, turns_per_chunk: int = TURNS_PER_CHUNK) -> DataFrame:
    """Lines in turn order joined by newlines, one row per conversation.

    Two levels: turns are first assembled per (conversation, chunk of turns), then the chunk
    texts per conversation. A very long conversation is thus spread over many tasks, and the
    final step only orders ``turns / turns_per_chunk`` pieces.
    """
    lines = transcript_lines(messages).withColumn("_chunk", F.floor(F.col("turn") / F.lit(turns_per_chunk)))
    pieces = lines.groupBy("conv_id", "_chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]),
                     LINE_SEP).alias("piece"),
        F.count("line").alias("n"))
    return pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "piece"))), lambda x: x["piece"]),
                     LINE_SEP).alias("transcript"),
        F.sum("n").alias("n_turns"))


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """The message list reducer is an append."""
    return history.unionByName(new)


def last_message(messages: DataFrame, tool_calls: str | None = "tool_calls") -> DataFrame:
    """The last message per conversation and the next step (``continue`` if it asks for tools)."""
    has_tools = tool_calls if tool_calls and tool_calls in messages.columns else None
    fields = [F.col("turn"), F.col("role"), F.col("text")]
    if has_tools:
        fields.append(F.col(has_tools).alias("tool_calls"))
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct(*fields), F.col("turn")).alias("m"))
    cont = (F.coalesce(F.size("m.tool_calls") > 0, F.lit(False)) if has_tools else F.lit(False))
    return last.select("conv_id", F.col("m.turn").alias("last_turn"), chat_role(F.col("m.role")).alias("last_role"),
                       F.length("m.text").cast("bigint").alias("last_chars"),
                       F.when(cont, "continue").otherwise("end").alias("next_step"))

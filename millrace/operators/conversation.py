"""Conversations as tables of ``conv_id``, ``turn``, ``role`` and ``text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import stripped

# The first message of a conversation without any, and the word that ends one.
SYSTEM_PROMPT = "You are a helpful assistant."
QUIT = "quit"

_KEY = "conv_id"


def contexts(log: DataFrame) -> DataFrame:
    """For every user turn ``context``, all messages up to and with it, in order.

    That is what a request sends, so the result grows with the square of a
    conversation's turns, and one conversation is one task's.
    """
    before = Window.partitionBy(_KEY).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = log.withColumn("context", F.collect_list(F.struct("role", "text")).over(before))
    return told.where(F.col("role") == "user").select(_KEY, "turn", "context")


def answered_only(log: DataFrame) -> DataFrame:
    """The log without user turns that no assistant turn follows: a turn counts with its reply, or not at all."""
    after = F.lead("role").over(Window.partitionBy(_KEY).orderBy("turn"))
    return log.withColumn("_next", after).where((F.col("role") != "user") | F.coalesce(F.col("_next") == "assistant", F.lit(False))).drop("_next")


def resume_points(log: DataFrame) -> DataFrame:
    """``conv_id``, ``messages`` and ``next_turn``."""
    return log.groupBy(_KEY).agg(F.count("*").alias("messages"), (F.max("turn") + 1).alias("next_turn"))


def append(log: DataFrame, replies: DataFrame) -> DataFrame:
    """The log with the replies of ``conv_id``, ``role`` and ``text`` as next turns; one reply a conversation."""
    points = resume_points(log).select(_KEY, "next_turn")
    new = replies.join(points, _KEY, "left").select(_KEY, F.coalesce("next_turn", F.lit(0)).cast("bigint").alias("turn"), "role", "text")
    return log.select(_KEY, "turn", "role", "text").unionByName(new)


def with_system(log: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """The log with a system message before the first turn of conversations that have none."""
    per = log.groupBy(_KEY).agg(F.max(F.col("role") == "system").alias("has"), (F.min("turn") - 1).alias("turn"))
    new = per.where(~F.col("has")).select(_KEY, "turn", F.lit("system").alias("role"), F.lit(prompt).alias("text"))
    return log.select(_KEY, "turn", "role", "text").unionByName(new)


def with_defaults(log: DataFrame, ids: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """The log with a system message as turn 0 for those of ``ids(conv_id)`` that have no rows at all."""
    new = ids.select(_KEY).distinct().join(log.select(_KEY).distinct(), _KEY, "left_anti")
    return log.select(_KEY, "turn", "role", "text").unionByName(new.select(_KEY, F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("text")))


def session_input(log: DataFrame) -> DataFrame:
    """The log without blank user turns, up to and without the first user turn that says quit."""
    said = stripped(F.coalesce(F.col("text"), F.lit("")))
    quits = (F.col("role") == "user") & (F.lower(said) == QUIT)
    ends = log.where(quits).groupBy(_KEY).agg(F.min("turn").alias("_end"))
    kept = log.join(ends, _KEY, "left").where(F.col("_end").isNull() | (F.col("turn") < F.col("_end"))).drop("_end")
    return kept.where((F.col("role") != "user") | (F.length(said) > 0))


def roll_back(log: DataFrame, results: DataFrame) -> DataFrame:
    """The log without the user turns whose row in ``results(conv_id, turn, error)`` has an error."""
    failed = results.where(F.col("error").isNotNull()).select(_KEY, "turn").withColumn("role", F.lit("user"))
    return log.join(failed, [_KEY, "turn", "role"], "left_anti").select(log.columns)

"""Conversations as streams of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import stripped
from millrace.operators.conversation import QUIT

CONTEXT = "conv_id bigint, turn bigint, n_messages bigint, roles string, texts string"


def live_contexts(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """For every user message of a stream of ``conv_id``, ``turn``, ``role`` and ``text``: the context that a request has.

    The state of a conversation is its messages so far; roles and texts are
    joined by line feeds.  Messages of one conversation must arrive by turn
    from batch to batch; within a batch they are sorted.  With
    ``idle_ms`` a conversation without a message for so many milliseconds is
    over: its state is dropped, and what comes later begins a new one.  Without
    it state is kept for ever.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, texts = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(list(frames)).sort_values("turn").itertuples():
            roles.append(row.role)
            texts.append(row.text or "")
            if row.role == "user":
                out.append((key[0], row.turn, len(roles), "\n".join(roles), "\n".join(texts)))
        state.update((roles, texts))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_messages", "roles", "texts"])

    grouped = messages.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return grouped.applyInPandasWithState(run, CONTEXT, "roles array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def spoken(messages: DataFrame) -> DataFrame:
    """A stream without blank user messages and those that say quit."""
    said = stripped(F.coalesce(F.col("text"), F.lit("")))
    return messages.where((F.col("role") != "user") | ((said != "") & (F.lower(said) != QUIT)))


def message_counts(messages: DataFrame, time_col: str, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Messages by window and role, in event time; what is later than ``delay`` is left out."""
    timed = messages.withWatermark(time_col, delay)
    return timed.groupBy(F.window(time_col, window), "role").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "role", "n")


class _Conversation(StatefulProcessor):
    """A conversation's messages in order, and those that came before one that they follow.

    Every look at the state is a call from Python to the executor, so there are
    a few for each conversation of a batch, not some for each message: a message
    that can be told at once never waits in the state.
    """

    def __init__(self, first_turn: int, wait_ms: int | None, ttl_ms: int | None) -> None:
        self.first_turn, self.wait_ms, self.ttl_ms = first_turn, wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "turn bigint", self.ttl_ms)
        self.log = handle.getListState("log", "role string, text string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "turn bigint", "role string, text string", self.ttl_ms)

    def _turn(self) -> int:
        held = self.next.get()
        return self.first_turn if held is None else held[0]

    def _told(self, key: tuple, ready: list[tuple[int, tuple]]) -> Iterator[Row]:
        """Contexts of the user messages among those that are put in order now."""
        # What is there already is read once, and only what is new is written.
        held = [tuple(m) for m in self.log.get()]
        new = len(held)
        for at, message in ready:
            held.append(message)
            if message[0] == "user":
                yield Row(conv_id=key[0], turn=at, n_messages=len(held), roles="\n".join(m[0] for m in held), texts="\n".join(m[1] for m in held))
        self.log.appendList(held[new:])
        self.next.update((ready[-1][0] + 1,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        turn = self._turn()
        waited = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        known = dict(waited)
        for row in rows:
            if row.turn >= turn:
                known.setdefault(row.turn, (row.role, row.text or ""))
        ready = []
        while turn in known:
            ready.append((turn, known.pop(turn)))
            turn += 1
        for at in waited.keys() - known.keys():
            self.waiting.removeKey((at,))
        for at in known.keys() - waited.keys():
            self.waiting.updateValue((at,), known[at])
        if ready:
            yield from self._told(key, ready)
        if self.wait_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if known:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ARG002, N802, N803
        ready = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
        if ready:
            self.waiting.clear()
            yield from self._told(key, ready)

    def close(self) -> None:
        pass


def ordered_contexts(messages: DataFrame, first_turn: int = 0, wait_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The rows of ``live_contexts`` for messages that may come late, out of order or more than once.

    A conversation's turns count from ``first_turn``.  A message waits for those
    before it; with ``wait_ms``, if they don't come within that time of the
    conversation's last message, those that wait are put in order without them,
    and what comes for an earlier turn later is left out.  Of messages with one
    turn the first counts.  The state is a list that messages are appended to
    and a map of those that wait, so a message writes itself only; with
    ``ttl_ms`` entries are dropped that long after they were written.  Either
    makes Spark look for what is due without end, so such a query is stopped,
    not awaited.  It needs the session's state store to be the one on RocksDB.
    """
    mode = "None" if wait_ms is None and ttl_ms is None else "ProcessingTime"
    grouped = messages.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return grouped.transformWithState(_Conversation(first_turn, wait_ms, ttl_ms), CONTEXT, "append", mode)


def replied(messages: DataFrame, time_col: str, within: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Each user message with the assistant's message of the next turn: ``conv_id``, ``turn``, ``asked``, ``text``, ``answered``, ``reply``.

    A reply counts if it is at most ``within`` later and not earlier than its
    request; a request that gets none has nulls, and comes out once the
    watermark, ``delay`` behind the latest message, is past its time.  Both
    sides' state goes then too.  Messages later than the watermark are left out,
    repeated ones are rows of their own, and messages without a time, turn or
    conversation are left out.  On a table the result is that
    of the whole stream.
    """
    timed = messages.withWatermark(time_col, delay).dropna(subset=["conv_id", "turn", time_col])
    asked = timed.where(F.col("role") == "user").select("conv_id", "turn", F.col(time_col).alias("asked"), "text")
    answers = timed.where(F.col("role") == "assistant").select(F.col("conv_id").alias("a_conv"), (F.col("turn") - 1).alias("a_turn"), F.col(time_col).alias("answered"), F.col("text").alias("reply"))
    near = (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    met = asked.join(answers, (F.col("conv_id") == F.col("a_conv")) & (F.col("turn") == F.col("a_turn")) & near, "left")
    return met.select("conv_id", "turn", "asked", "text", "answered", "reply")

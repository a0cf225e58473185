import sys

import pytest
from pyspark import cloudpickle

from millrace.operators import conversation as c
from millrace.sources.providers import EchoChat, ProviderError, replies

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

LOG = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [
            (1, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", "more"),
            (2, 0, "user", "  "), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (2, 3, "user", " QUIT \t"), (2, 4, "user", "late"),
            (3, 5, "user", None),
        ],
        LOG,
    ).repartition(3)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contexts(log):
    got = {(r.conv_id, r.turn): [m.text for m in r.context] for r in c.contexts(log).collect()}
    assert got[1, 1] == ["s", "hello"] and got[1, 3] == ["s", "hello", "hi", "more"] and len(got) == 7


def test_turns_without_replies_are_dropped(log):
    assert rows(c.answered_only(log), "conv_id", "turn") == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_resume_and_append(spark, log):
    assert rows(c.resume_points(log), "conv_id", "messages", "next_turn") == [(1, 4, 4), (2, 5, 5), (3, 1, 6)]
    new = spark.createDataFrame([(1, "assistant", "x"), (9, "user", "first")], "conv_id bigint, role string, text string")
    grown = c.append(log, new)
    assert grown.count() == log.count() + 2
    assert rows(grown.where("text in ('x', 'first')"), "conv_id", "turn") == [(1, 4), (9, 0)]


def test_system_messages(spark, log):
    assert rows(c.with_system(log).where("role = 'system'"), "conv_id", "turn", "text") == [(1, 0, "s"), (2, -1, c.SYSTEM_PROMPT), (3, 4, c.SYSTEM_PROMPT)]
    ids = spark.createDataFrame([(1,), (7,), (7,)], "conv_id bigint")
    assert rows(c.with_defaults(log, ids).where("conv_id = 7"), "turn", "role") == [(0, "system")]


def test_blank_input_and_quit(log):
    assert rows(c.session_input(log), "conv_id", "turn") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


class Failing(EchoChat):
    def reply(self, messages):
        if messages[-1]["content"] == "more":
            raise ProviderError("Request timed out.")
        return super().reply(messages)


def test_failed_turns_are_rolled_back(log):
    made = replies(c.contexts(log.where("text is not null")), Failing())
    found = {(r.conv_id, r.turn): (r.reply, r.error) for r in made.collect()}
    assert found[1, 1] == ("[2] hello", None) and found[1, 3] == (None, "Request timed out.")
    assert (1, 3) not in rows(c.roll_back(log, made), "conv_id", "turn") and c.roll_back(log, made).count() == log.count() - 1


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    for df in (c.contexts(empty), c.answered_only(empty), c.resume_points(empty), c.with_system(empty), c.session_input(empty), replies(c.contexts(empty), EchoChat())):
        assert df.count() == 0

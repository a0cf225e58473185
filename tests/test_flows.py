import json
import sys

import pytest
from pyspark import cloudpickle

from millrace.operators import samples
from millrace.plans import flows
from millrace.sources.providers import EchoChat, ProviderError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Failing(EchoChat):
    def reply(self, messages):
        if "fail" in messages[-1]["content"]:
            raise ProviderError("down")
        return super().reply(messages)


def test_chat_turns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    said = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, " "), (4, "Quit")], "conv_id bigint, text string")
    log, errors = flows.chat_turn(empty, said, Failing())
    assert sorted(tuple(r) for r in log.collect()) == [(1, 0, "system", "You are a helpful assistant."), (1, 1, "user", "hello"), (1, 2, "assistant", "[2] hello"), (2, 0, "system", "You are a helpful assistant.")]
    assert [tuple(r) for r in errors.collect()] == [(2, "down")]
    again, _ = flows.chat_turn(log, spark.createDataFrame([(1, "more")], "conv_id bigint, text string"), Failing())
    assert [r.text for r in again.where("conv_id = 1").orderBy("turn").collect()][-2:] == ["more", "[4] more"]
    assert again.where("conv_id = 2").count() == 1


@pytest.fixture
def corpus(tmp_path):
    docs = [{"id": 1, "topic": "sky", "text": "a light year is how far light goes in a year"}, {"id": 2, "topic": "food", "text": "bread needs flour and water"}, {"id": 3, "topic": "food", "text": "soup needs water"}, {"id": 4, "topic": "sky"}]
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    return str(tmp_path / "docs.json")


def test_search_in_a_file(spark, corpus, tmp_path):
    for where in (None, str(tmp_path / "cache"), str(tmp_path / "cache")):
        rows = flows.semantic_search(spark, corpus, ["how far is a light year", "water for bread"], 2, where).collect()
        best = {r.query_id: r for r in rows if r["rank"] == 1}
        assert best[0].id == 1 and best[1].id == 2 and len(rows) == 4 and all(-1 <= r.score <= 1 + 1e-12 for r in rows)


def test_topics(spark, corpus):
    rows = flows.topic_map(spark, corpus).collect()
    assert len(rows) == 4 and abs(sum(r.pc1 for r in rows)) < 1e-12


def test_samples(spark):
    points = samples.blobs(spark).collect()
    assert len(points) == 60 and len({p.id for p in points}) == 60
    for label, centre in ((0, 2.0), (1, -2.0)):
        own = [p.v for p in points if p.label == label]
        assert abs(sum(v[0] for v in own) / 30 - centre) < 1
    line = samples.noisy_line(spark).collect()
    assert len(line) == 200 and 1.5 < sum(r.x * r.y for r in line) / sum(r.x * r.x for r in line) < 2.5

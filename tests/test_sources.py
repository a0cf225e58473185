import json
import sys
import threading
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.sources import cache, files, providers, shared
from millrace.sources.config import Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

DOCS = "doc_id bigint, text string"


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "topic": "a", "text": "x"}, {"id": 2, "topic": "b"}, {"id": 3, "topic": "b", "text": None}], indent=1))
    assert [(r.id, r.text) for r in files.load_documents(spark, str(tmp_path / "d.json")).orderBy("id").collect()] == [(1, "x"), (2, ""), (3, "")]
    (tmp_path / "bad.json").write_text('[{"id": 1,')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.load_documents(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.load_documents(spark, str(tmp_path / "none.json"))


@pytest.mark.parametrize(("content", "status", "n"), [('[{"role": "system", "content": "é"}, {"role": "user", "content": "b"}]', "ok", 2), ("[]", "ok", 0), ("", "corrupt", 0), ("[{", "corrupt", 0), (None, "missing", 0)])
def test_history(spark, tmp_path, content, status, n):
    if content is not None:
        (tmp_path / "h.json").write_text(content)
    got, rows = files.load_history(spark, str(tmp_path / "h.json"))
    assert got == status and rows.count() == n
    if n:
        assert [(r.turn, r.role, r.content) for r in rows.orderBy("turn").collect()] == [(0, "system", "é"), (1, "user", "b")]


def test_save_replaces_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    files.save(spark.range(3), path)
    files.save(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_history_json(spark):
    log = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "system", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert json.loads(files.history_json(log).first().json) == [{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]


@dataclass(frozen=True)
class Counting:
    """Embeds and leaves a file for every text."""

    folder: str
    mode: str = "counting"
    dim: int = 4

    def embed(self, texts, input_type):
        import uuid

        for _ in texts:
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return [[float(len(t))] * self.dim for t in texts]


def test_cache_embeds_only_what_is_new(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path, provider = str(tmp_path / "cache"), Counting(str(calls))
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], DOCS)
    first = {r.doc_id: r.embedding for r in cache.embeddings(docs, path, provider).collect()}
    assert first == {1: [1.0] * 4, 2: [2.0] * 4, 3: [0.0] * 4}
    n = len(list(calls.iterdir()))
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 2, "edited").otherwise(F.col("text")))
    assert {r.doc_id: r.embedding[0] for r in cache.embeddings(edited, path, provider).collect()} == {1: 1.0, 2: 6.0, 3: 0.0}
    assert len(list(calls.iterdir())) == n + 1
    assert cache.embeddings(docs, path, providers.HashEmbedding()).count() == 3  # modes don't mix
    with pytest.raises(ValueError, match="differ in width"):
        cache.embeddings(spark.createDataFrame([(9, "new")], DOCS), path, Counting(str(calls), dim=5))
    assert cache.embeddings(docs.limit(0), path, provider).count() == 0


@dataclass(frozen=True)
class Broken:
    mode: str = "broken"

    def embed(self, texts, input_type):
        raise providers.ProviderError("down")


def test_fallback_is_chosen_and_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], DOCS)
    with pytest.raises(Exception, match="down"):
        cache.embeddings(docs, str(tmp_path / "c"), Broken())
    rows = cache.embeddings(docs, str(tmp_path / "c"), Broken(), on_error="fallback").collect()
    assert len(rows) == 2 and all(len(r.embedding) == 64 for r in rows)


class Answers(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/fail":
            self.send_response(429)
            self.end_headers()
            self.wfile.write(b"slow down " * 100)
            return
        self.send_response(200)
        self.end_headers()
        answer = {"choices": [{"message": {"content": f"{body['model']}:{len(body['messages'])}"}}]} if "messages" in body else {"data": [{"embedding": [float(len(t)), body["input_type"] == "query"]} for t in body["input"]]}
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_http_providers():
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert providers.HttpChat(base, "m", "k").reply([{"role": "user", "content": "x"}]) == "m:1"
        assert providers.HttpEmbedding(base, "m", "k").embed(["abc", ""], "query") == [[3.0, True], [0.0, True]]
        with pytest.raises(providers.ProviderError, match="HTTP error 429") as e:
            providers.HttpChat(f"{base}/fail", "m", "k").reply([])
        assert len(str(e.value)) <= len("HTTP error 429: ") + 200
    finally:
        server.shutdown()
    with pytest.raises(providers.ProviderError, match="Could not connect"):
        providers.HttpChat("http://127.0.0.1:9", "m", "k").reply([])
    with pytest.raises(ValueError):
        providers.HttpChat(base, "m", "")


def test_settings_choose_the_provider():
    assert isinstance(providers.embedding_provider(Settings()), providers.HashEmbedding)
    api = Settings(mode="api", api_key="k", embedding_url="http://127.0.0.1:9", embedding_model="m", chat_url="http://127.0.0.1:9", chat_model="c")
    assert providers.embedding_provider(api) == providers.HttpEmbedding("http://127.0.0.1:9", "m", "k")
    assert providers.chat_provider(api) == providers.HttpChat("http://127.0.0.1:9", "c", "k")
    for make in (providers.embedding_provider, providers.chat_provider):
        with pytest.raises(ValueError, match="key"):
            make(Settings(mode="api"))
    with pytest.raises(providers.ProviderError):
        providers.embed_texts(["a"], api)
    offline = providers.embed_texts(["a b", ""], Settings())
    assert providers.embed_texts(["a b", ""], Settings(mode="api", api_key="k", embedding_url="http://127.0.0.1:9", on_error="fallback")) == offline
    assert len(offline[0]) == 64 and not any(offline[1])


def test_a_save_that_is_cut_off_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.save(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        files.save(spark.range(5).select(F.raise_error(F.lit("broken"))), path)
    assert spark.read.parquet(path).count() == 3


def test_shared_tables_are_dropped(spark):
    before = shared.materialize(spark.range(3))
    point = shared.mark()
    gone, kept, empty = shared.materialize(spark.range(4)), shared.materialize(spark.range(5)), shared.materialize(spark.range(0))
    shared.drop_since(point, kept, empty)
    assert (before.count(), kept.count(), empty.count()) == (3, 5, 0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        gone.collect()
    assert [b.num_rows for b in shared.blocks(shared.written(spark.range(0, 10, 1, 1)), 4)] == [4, 4, 2]
    assert "://" in shared.shared_dir(spark)


def test_histories(spark, tmp_path):
    log = spark.createDataFrame([(1, 4, "user", "b\n\"é"), (1, 0, "system", "a"), (2, 3, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    files.save_histories(log, str(tmp_path / "h"))
    rows = files.load_histories(spark, str(tmp_path / "h"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, "system", "a"), (1, 1, "user", "b\n\"é"), (2, 0, "user", "")]
    (tmp_path / "bad").write_text('{"conv_id": 1, "messages": [')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.load_histories(spark, str(tmp_path / "bad")).collect()


def test_settings(monkeypatch):
    assert Settings().mode == "offline"
    for wrong in ({"mode": "other"}, {"on_error": "maybe"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    with pytest.raises(ValueError):
        Settings(mode="api").key()
    monkeypatch.setenv("MILLRACE_MODE", "api")
    monkeypatch.setenv("MILLRACE_API_KEY", "k")
    assert Settings.from_environment().key() == "k"


def test_cache_of_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha"), (1, "beta gamma"), (None, "alpha"), (None, None), (2, ""), (3, "beta gamma")], DOCS)
    path, provider = str(tmp_path / "c"), providers.HashEmbedding(dim=8)
    plain = {t: provider.embed([t])[0] for t in ("alpha", "beta gamma", "")}
    for _ in range(2):
        made = sorted(((r.doc_id or -1, r.embedding) for r in cache.embeddings(docs, path, provider).collect()), key=str)
        assert made == sorted(((i, plain[t]) for i, t in [(1, "alpha"), (1, "beta gamma"), (-1, "alpha"), (-1, ""), (2, ""), (3, "beta gamma")]), key=str)
    assert spark.read.parquet(f"{path}/mode=offline").count() == 3
    more = docs.union(spark.createDataFrame([(1, "new"), (1, "new")], DOCS))
    assert [r.doc_id for r in cache.missing(more, path, "offline").collect()] == [1, 1]


def test_cache_lookup_shuffles_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], DOCS)
    cache.embeddings(docs, str(tmp_path / "c"), providers.HashEmbedding())
    plan = cache.missing(docs, str(tmp_path / "c"), "offline")._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line and "body" not in line for line in plan.split("\n") if "Exchange" in line)


def test_cache_embeds_few_old_texts_where_many_are_new(spark, tmp_path, monkeypatch):
    """Also where the new hashes are too many to be sent to all tasks; before, every vector was made again then."""
    monkeypatch.setattr(cache, "BROADCAST_HASHES", 10)
    path, provider = str(tmp_path / "c"), providers.HashEmbedding()
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text")
    cache.embeddings(docs, path, provider)
    given, real = [], cache.embed
    monkeypatch.setattr(cache, "embed", lambda rows, *a: given.append(rows.count()) or real(rows, *a))
    edited = docs.selectExpr("doc_id", "if(doc_id % 10 = 0, concat(text, ' edited'), text) as text")
    rows = cache.embeddings(edited, path, provider)
    assert 200 <= given[0] < 220 and rows.count() == 2000
    assert not {r.doc_id for r in cache.missing(edited, path, provider.mode).collect()}

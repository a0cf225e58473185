import time
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators.conversation import contexts
from millrace.streaming import conversation as live

LOG = "conv_id bigint, turn bigint, role string, text string"


def drained(stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_contexts_as_in_batch(spark, tmp_path):
    log = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c in range(3) for t in range(6)], LOG)
    for part in range(3):  # three files, turn by turn
        log.where(F.col("turn").between(2 * part, 2 * part + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.conv_id, r.turn): r.texts.split("\n") for r in drained(live.live_contexts(stream), "contexts").collect()}
    assert got == {(r.conv_id, r.turn): [m.text for m in r.context] for r in contexts(log).collect()}


def test_spoken_and_counts(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, ts timestamp"
    rows = spark.range(8).selectExpr("id as conv_id", "id as turn", "'user' as role", "case id when 1 then ' ' when 2 then 'Quit ' else 'x' end as text", "timestamp_seconds(id * 600) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert drained(live.spoken(stream), "spoken").count() == 6
    counts = drained(live.message_counts(stream, "ts"), "counts").collect()
    assert counts and all(r.n == 1 for r in counts)


def test_idle_conversations_are_forgotten(spark, tmp_path):
    def add(turn):
        spark.createDataFrame([(1, turn, "user", str(turn))], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def seen(turn):  # batches go on for ever while there is state that may end
        for _ in range(100):
            found = spark.table("idle").where(F.col("turn") == turn).collect()
            if found:
                return found[0].n_messages
            time.sleep(0.2)

    add(0)
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    query = live.live_contexts(stream, idle_ms=2000).writeStream.outputMode("append").format("memory").queryName("idle").start()
    try:
        assert seen(0) == 1
        time.sleep(6)
        add(2)
        assert seen(2) == 1
    finally:
        query.stop()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_ordered_contexts_of_late_and_repeated_messages(spark, tmp_path):
    """Three runs on one checkpoint, each with some of the messages, in any order and some of them again."""
    log = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (1, 3) else f"{c}-{t}") for c in range(4) for t in range(7)], LOG)
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i in range(3):
            log.where(part == i).union(log.where((part <= i) & (F.col("turn") % 3 == 0))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
            query = live.ordered_contexts(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
            query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    expected = {(r.conv_id, r.turn): [m.text or "" for m in r.context] for r in contexts(log).collect()}
    assert len(rows) == len(expected) and {(r.conv_id, r.turn): r.texts.split("\n") for r in rows} == expected


def test_what_waits_too_long_goes_on(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", "c"), (1, 3, "user", "d")], LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        query = live.ordered_contexts(stream, wait_ms=1000, ttl_ms=600_000).writeStream.outputMode("append").format("memory").queryName("waits").start()
        for _ in range(150):
            if spark.table("waits").count() == 3:
                break
            time.sleep(0.2)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert {(r.turn, r.texts) for r in spark.table("waits").collect()} == {(0, "a"), (2, "a\nc"), (3, "a\nc\nd")}


def test_replies_as_in_batch(spark, tmp_path):
    """Replies before and after their requests' files, late, too late, repeated and missing ones."""
    schema = f"{LOG}, ts timestamp"

    def row(conv, turn, role, minute, text="x"):
        return (conv, turn, role, text, None if minute is None else 60 * (minute + 1000))

    parts = [
        [row(1, 0, "user", 0), row(1, 1, "assistant", 3), row(2, 0, "user", 1), row(3, 1, "assistant", 5), row(4, 0, "user", 2), row(5, 0, "user", None), row(None, 0, "user", 3)],
        [row(2, 1, "assistant", 4, "late"), row(3, 0, "user", 4), row(3, 1, "assistant", 6, "again"), row(6, 0, "user", 8), row(6, 1, "assistant", 7, "before")],
        [row(6, 1, "assistant", 30, "too late"), row(7, 0, "user", 30), row(7, 1, "assistant", 31)],
        [row(9, 0, "assistant", 500)],
        [row(9, 0, "assistant", 501)],
    ]
    made = [spark.createDataFrame(p, f"{LOG}, s bigint").selectExpr("conv_id", "turn", "role", "text", "timestamp_seconds(s) as ts") for p in parts]
    for i, part in enumerate(made):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = drained(live.replied(stream, "ts"), "replied")
    whole = live.replied(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts")
    assert Counter(map(tuple, found.collect())) - Counter(map(tuple, whole.collect())) == Counter() == Counter(map(tuple, whole.collect())) - Counter(map(tuple, found.collect()))
    assert {(r.conv_id, r.reply) for r in found.collect()} == {(1, "x"), (2, "late"), (3, "x"), (3, "again"), (4, None), (6, None), (7, "x")}


class Held:
    """A state variable that counts what is asked of it."""

    def __init__(self):
        self.calls, self.list, self.map, self.value = Counter(), [], {}, None

    def __getattr__(self, name):
        act = {
            "get": lambda: iter(list(self.list)) if self.list or self.value is None else self.value, "update": lambda v: setattr(self, "value", v),
            "appendList": self.list.extend, "iterator": lambda: iter([((k,), v) for k, v in self.map.items()]),
            "updateValue": lambda k, v: self.map.update({k[0]: v}), "removeKey": lambda k: self.map.pop(k[0]), "clear": self.map.clear,
        }[name]
        return lambda *a: self.calls.update([name]) or act(*a)


class Value(Held):
    def get(self):
        self.calls.update(["get"])
        return self.value


def test_state_is_asked_by_batch_and_not_by_message():
    from pyspark.sql import Row

    one = live._Conversation(0, None, None)
    one.next, one.log, one.waiting = Value(), Held(), Held()

    def said(*turns):
        rows = [Row(conv_id=1, turn=t, role="user", text=str(t)) for t in turns]
        return [(r.turn, r.n_messages, r.texts.split("\n")[-1]) for r in one.handleInputRows((1,), iter(rows), None)]

    assert said(*range(100), 101, 101) == [(t, t + 1, str(t)) for t in range(100)]
    assert sum((one.next.calls + one.log.calls + one.waiting.calls).values()) <= 6
    assert one.waiting.map == {101: ("user", "101")}
    assert said(100, 5) == [(100, 101, "100"), (101, 102, "101")]
    assert one.waiting.map == {} and one.next.value == (102,) and len(one.log.list) == 102

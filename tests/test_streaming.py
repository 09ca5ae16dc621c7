import json
import time

import pandas as pd
from pyspark.sql import functions as F

from keyloom.plans import planner, samples
from keyloom.plans.batch import ENVELOPE, Options, imperative, sent
from keyloom.processor import Mp, MpFactory
from keyloom.sources.adaptors import Adaptor, stream_sink
from keyloom.streaming import stateful, windows
from keyloom.topology import Node


def written(spark, path, rows, files=3):
    df = spark.createDataFrame([("event", str(k), f'{{"event_id": {i}, "user_id": {k}}}', i) for i, k in rows], ENVELOPE)
    df.repartitionByRange(files, "seq").write.mode("append").parquet(path)
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 5) for i in range(90)]
    stream = written(spark, str(tmp_path / "in"), rows)
    got = stateful.collected(stateful.keyed(stream, samples.counter()), "counts")
    table = spark.read.parquet(str(tmp_path / "in"))
    last = lambda found: {k: max(n for kk, n in found if kk == k) for k, _ in found}
    one = last([(r["key"], int(r["payload"].split('"count": ')[1].split(",")[0])) for r in got if r["kind"] == "message"])
    two = last([(r["key"], int(r["payload"].split('"count": ')[1].split(",")[0])) for r in imperative(table, samples.counter()).where("kind = 'message'").collect()])
    assert one == two == {str(k): 17 for k in range(5)}


def test_two_stateful_stages_in_one_query(spark, tmp_path):
    stream = written(spark, str(tmp_path / "in"), [(i, i % 3) for i in range(30)], 1)
    first = stateful.keyed(stream, samples.functional_counter())
    second = stateful.keyed(sent(first), samples.putter())
    got = stateful.collected(second, "chained", "append")
    assert sum(r["kind"] == "processed" for r in got) == 30 and sum(r["kind"] == "created" for r in got) == 3


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in range(2):
        stream = written(spark, source, [(i, 1) for i in range(part * 10, part * 10 + 10)], 1)
        stream_sink(stateful.keyed(stream, samples.counter()).where("kind = 'message'"), out, mark).awaitTermination()
    counts = spark.read.parquet(out).select(F.get_json_object("payload", "$.count").cast("int").alias("n")).collect()
    assert sorted(r["n"] for r in counts) == list(range(20))


def test_timers_put_out_and_evict(spark, tmp_path):
    stream = written(spark, str(tmp_path / "in"), [(i, i % 2) for i in range(10)], 1)
    results = stateful.keyed(stream, samples.counter(), output_every=1)
    query = results.writeStream.format("memory").queryName("timed").outputMode("update").trigger(processingTime="1 second").start()
    until = time.time() + 90
    found = set()
    while time.time() < until and len(found) < 2:
        time.sleep(1)
        found = {r["key"] for r in spark.table("timed").where("message_type = 'total'").collect()}
    query.stop()
    assert found == {"0", "1"}


def test_each_schedule_has_its_own_time():
    class Timers:
        def __init__(self):
            self.at = []

        def registerTimer(self, due):
            self.at.append(due)

    stage = stateful.Keyed(samples.evicting(), output_every=5, evict_every=5.0)
    stage.handle, due = Timers(), {"output": 0, "evict": 0}
    stage._arm(1000, due)
    assert due == {"output": 6000, "evict": 6000} and stage.handle.at == [6000, 6000]
    due = {"output": 6000, "evict": 9000}
    stage._arm(6000, due)
    assert due == {"output": 11_000, "evict": 9000}
    stage = stateful.Keyed(samples.evicting(), output_every="0 0 * * * ?")
    stage.handle, due = Timers(), {"output": 0, "evict": 0}
    stage._arm(3_600_000 * 5 + 1, due)
    assert due == {"output": 3_600_000 * 6, "evict": 0}


def test_instances_before_their_first_message(spark, tmp_path):
    stream = written(spark, str(tmp_path / "in"), [(i, 1) for i in range(4)], 1)
    got = stateful.collected(stateful.keyed(stream, samples.counter(), keys=spark.createDataFrame([("1",), ("2",), (None,)], "key string")), "preset")
    assert [r["key"] for r in got if r["kind"] == "created"] == [] and sum(r["kind"] == "processed" for r in got) == 4


def test_a_topology_that_feeds_back_runs_as_streams(spark, tmp_path):
    rows = [("hop", str(k % 3), f'{{"user_id": {k % 3}, "hops": {k % 4}}}', k) for k in range(12)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.parquet(str(tmp_path / "in"))

    class Ready(Adaptor):
        def read(self, spark):
            return spark.readStream.schema(ENVELOPE).parquet(str(tmp_path / "in"))

    node = Node.builder("a").default_routing("managed").receiver().cluster("read").adaptor(Ready()).cluster("hop").mp(samples.Hopper()).cluster("see").mp(MpFactory.make(Silent, "seen")).build()
    streams = planner.Streams(spark, str(tmp_path / "run"), node)
    assert streams.drain() >= 4
    assert streams.results("see").where("kind = 'processed'").count() == sum(k % 4 + 1 for k in range(12))
    spark.createDataFrame(rows[3:4], ENVELOPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    planner.Streams(spark, str(tmp_path / "run"), node).drain()
    assert streams.results("see").where("kind = 'processed'").count() == sum(k % 4 + 1 for k in range(12)) + 4
    streams.delete()
    assert not (tmp_path / "run").exists()


class Silent(Mp):
    def handle(self, message):
        return None


def test_windows_of_a_stream_match_those_of_a_table(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 977).alias("ts"), (F.col("id") % 3).alias("k"))
    df.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    aggs = {"n": F.count("*")}
    key = lambda r: (r["window_start"], r["k"], r["n"])
    for name, make in {"tumbling": lambda d: windows.tumbling(d, "ts", "1 hour", ["k"], aggs, "1 hour"), "sliding": lambda d: windows.sliding(d, "ts", "2 hours", "1 hour", ["k"], aggs, "1 hour")}.items():
        assert {key(r) for r in stateful.collected(make(stream), name)} == {key(r) for r in make(df).collect()}


def test_a_key_asks_the_state_store_once_and_returns_what_is_wanted():
    class Held:
        asked, value = 0, None

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

        def exists(self):
            raise AssertionError("a second question")

    class Timer:
        def getCurrentProcessingTimeInMs(self):
            return 0

    class Handle:
        held = Held()

        def getValueState(self, name, schema):
            return self.held

    own = stateful.Keyed(samples.counter(), Options(kinds=frozenset({"message"})))
    own.init(Handle())
    for first in (0, 3):
        rows = pd.DataFrame([("event", f'{{"event_id": {i}, "user_id": 1}}', i, b"") for i in (first + 2, first, first + 1)], columns=["message_type", "payload", "seq", "place"])
        got = pd.concat(own.handleInputRows(("1",), iter([rows]), Timer()))
        assert got["kind"].tolist() == ["message"] * 3 and [json.loads(x)["count"] for x in got["payload"]] == [first, first + 1, first + 2]
    assert Handle.held.asked == 2

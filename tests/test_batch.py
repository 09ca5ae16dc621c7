import hashlib
import json

from pyspark import cloudpickle
from pyspark.sql import functions as F

from keyloom.model import TypedMessage, to_json
from keyloom.operators import fanout, feedback, joins, lifecycle, metrics, routing, shedding
from keyloom.plans import planner, samples
from keyloom.plans.batch import ENVELOPE, NAMES, Declarative, States, Unfinished, imperative, place, run, sent, unfolded
from keyloom.processor import Mp, MpFactory, Processor
from keyloom.sources.adaptors import ADAPTORS, DispatcherAdaptor, DummyDispatcher, Registry, from_json_messages, json_messages, null_sink
from keyloom.topology import Node, Topology, TopologyError

import pytest


def messages(spark, rows):
    return spark.createDataFrame([("event", str(k), f'{{"event_id": {i}, "user_id": {k}}}', i) for i, k in rows], ENVELOPE)


def kinds(results):
    return {r["kind"]: r["count"] for r in results.groupBy("kind").count().collect()}


def test_counts_failures_and_lives(spark):
    rows = [(i, i % 3) for i in range(60)]
    df = messages(spark, rows)
    assert kinds(imperative(df, samples.counter())) == {"created": 3, "dispatched": 60, "processed": 60, "message": 60}
    bad = imperative(df, samples.failing())
    failed = sum(i % 10 == 3 for i, _ in rows)
    assert kinds(bad)["failed"] == failed and kinds(bad)["message"] == 60 - failed
    assert metrics.balances(metrics.cluster_counts(bad), 60) == {"received": True, "handled": True, "live": True}
    gone = kinds(imperative(df, samples.evicting(), stop=True, evict_span=1, end=60))
    assert gone["evicted"] == 6 and gone["created"] == gone["deleted"]
    assert "evicted" not in kinds(imperative(df, samples.evicting()))


def test_a_failed_activation_loses_its_message(spark):
    class Fussy(Mp):
        def activate(self, key, first, state):
            if first["event_id"] < 3:
                raise ValueError

        def handle(self, message):
            return TypedMessage(message.key, {"n": 1}, ("one",))

    got = kinds(imperative(messages(spark, [(i, 1) for i in range(5)]), MpFactory.make(Fussy, "event")))
    assert got == {"failed": 3, "created": 1, "dispatched": 2, "processed": 2, "message": 2}


def test_results_without_a_key_are_counted(spark):
    class Loose(Mp):
        def handle(self, message):
            return object()

    assert kinds(imperative(messages(spark, [(1, 1)]), MpFactory.make(Loose, "event")))["unkeyed"] == 1


def test_what_fails_is_counted_and_the_rest_goes_on(spark):
    class BadKey(samples.Count):
        @samples.message_key
        def key(self):
            raise RuntimeError("no key")

    class Wrong(Mp):
        n = 0

        def handle(self, message):
            self.n += 1
            return [BadKey("k", 1), TypedMessage(message.key, {"n": self.n}, ("one",))]

        def output(self):
            raise RuntimeError("no output")

    df = messages(spark, [(i, 1) for i in range(3)]).union(spark.createDataFrame([("event", "1", "{no json", 9)], ENVELOPE))
    got = imperative(df, MpFactory.make(Wrong, "event", outputs=True), final_output=True)
    assert kinds(got.where("kind <> 'timing'")) == {"created": 1, "dispatched": 4, "processed": 3, "failed": 1, "message": 3, "unsent": 3, "output_failed": 1}
    assert metrics.balances(metrics.cluster_counts(got), 4) == {"received": True, "handled": True, "live": True}
    assert metrics.timers(got).first()["passes"] == 1


def test_every_message_of_a_lost_pile_counts(spark):
    class Never(Mp):
        def activate(self, key, first, state):
            raise ValueError

    df = messages(spark, [(i, 1) for i in range(9)])
    got = imperative(df, MpFactory.make(Never, "event"), bulk=True)
    assert kinds(got) == {"failed": 9}
    assert metrics.balances(metrics.cluster_counts(got), 9) == {"received": True, "handled": True, "live": True}


def test_results_of_one_cause_keep_their_order(spark):
    node = Node.builder("a").default_routing("managed").receiver().cluster("burst").mp(samples.Burst()).cluster("in_order").mp(samples.InOrder()).build()
    got = run(Topology(node), messages(spark, [(i, i % 2) for i in range(6)]))["in_order"].where("kind = 'processed'").orderBy("key", "seq", "place").collect()
    assert [r["seq"] for r in got] == [i for k in (0, 1) for i in range(6) if i % 2 == k for _ in range(12)]
    last = sent(run(Topology(node), messages(spark, [(i, 0) for i in range(3)]))["in_order"]).orderBy(F.desc("seq"), F.desc("place")).first()
    assert hashlib.md5((",".join(map(str, range(12))) + ",").encode() * 3).hexdigest() in last["payload"]


def test_places_sort_by_parent_and_then_by_number():
    numbers = [0, 1, 239, 240, 255, 256, 65_535, 65_536, 1 << 40]
    own = [place(b"", n) for n in numbers]
    assert own == sorted(own) and len(set(own)) == len(own)
    assert place(own[1], 5) < own[2] and own[1] < place(own[1], 0)


def test_order_within_a_key(spark):
    df = messages(spark, [(i, 1) for i in range(50)]).repartition(4)
    got = imperative(df, samples.counter()).where("kind = 'message'").select("seq", F.get_json_object("payload", "$.count").cast("long").alias("n")).collect()
    assert all(r["seq"] == r["n"] for r in got) and len(got) == 50


def test_both_lowerings_agree(spark):
    df = messages(spark, [(i, i * i % 7) for i in range(200)])
    one = {(r["seq"], r["n"]) for r in Declarative({"n": F.count(F.lit(1))}, before=True).lower(df, "key", "seq").collect()}
    two = {(r["seq"], r["n"]) for r in imperative(df, samples.counter()).where("kind = 'message'").select("seq", F.get_json_object("payload", "$.count").cast("long").alias("n")).collect()}
    assert one == two


def test_feedback_ends_and_keeps_state(spark):
    class Hops(Mp):
        def __init__(self):
            self.seen = 0

        def handle(self, message):
            self.seen += 1
            left = message.message["event_id"] - 1
            return TypedMessage(message.key, {"event_id": left, "seen": self.seen}, ("event",)) if left > 0 else TypedMessage(message.key, {"seen": self.seen}, ("end",))

    node = Node.builder("a").default_routing("managed").receiver().cluster("hop").mp(MpFactory.make(Hops, "event")).build()
    got = run(Topology(node), messages(spark, [(4, 1), (1, 2)]))["hop"]
    ends = {(r["key"], r["payload"]) for r in got.where("message_type = 'end'").collect()}
    assert ends == {("1", '{"seen": 4}'), ("2", '{"seen": 1}')}


def test_rounds_that_end_early_lose_nothing(spark):
    node = Node.builder("a").default_routing("managed").receiver().cluster("hop").mp(samples.Hopper()).build()
    first = spark.createDataFrame([("hop", "1", '{"user_id": 1, "hops": 8}', 1)], ENVELOPE)
    with pytest.raises(Unfinished) as stopped:
        run(Topology(node), first, rounds=5)
    assert stopped.value.pending.where("message_type = 'hop'").count() == 1 and stopped.value.found["hop"].where("kind = 'processed'").count() == 5
    got = run(Topology(node), first)["hop"]
    assert got.where("message_type = 'seen' AND kind = 'message'").count() == 9


def test_instances_that_are_evicted_in_a_loop_stay_gone(spark):
    class Once(Mp):
        def __init__(self):
            self.n = 0

        def handle(self, message):
            self.n += 1
            left = message.message["left"]
            return [TypedMessage(message.key, {"n": self.n}, ("n",)), TypedMessage("b" if message.key == "a" else "a", {"left": left - 1}, ("go",)) if left else None]

        def should_be_evicted(self):
            return self.n >= 2

    node = Node.builder("a").default_routing("managed").receiver().cluster("c").mp(MpFactory.make(Once, "go", evictable=True)).evict_every(10).build()
    rows = [("go", "a", '{"left": 0}', s) for s in (1, 2, 11, 12, 21)]
    got = run(Topology(node), spark.createDataFrame(rows, ENVELOPE))["c"]
    assert [r["payload"] for r in got.where("kind = 'message'").orderBy("seq").collect()] == [f'{{"n": {n}}}' for n in (1, 2, 1, 2, 1)]
    assert kinds(got.where("kind IN ('evicted', 'created')")) == {"evicted": 2, "created": 3}
    rows = [("go", "a", '{"left": 12}', 1)]
    got = run(Topology(node), spark.createDataFrame(rows, ENVELOPE))["c"]
    assert max(json.loads(r["payload"])["n"] for r in got.where("message_type = 'n'").collect()) == 7


def test_state_is_kept_as_deltas(spark):
    own = States()
    for k in range(12):
        own.add(spark.createDataFrame([("a", k, bytes([k])), (f"b{k}", k, b"x" if k % 2 else None)], "key string, seq long, state binary"))
    found = {r["key"]: bytes(r["state"]) for r in own.all().collect()}
    assert found == {"a": bytes([11])} | {f"b{k}": b"x" for k in range(12) if k % 2} and len(own.deltas) <= 8
    assert [r["key"] for r in own.all(spark.createDataFrame([("b1",), ("c",)], "key string")).collect()] == ["b1"]


def test_outputs_by_the_clock_of_the_table(spark):
    node = Node.builder("a").default_routing("managed").receiver().cluster("count").mp(samples.Counter()).output_every(10).key_source(lambda: ["7", "1"]).build()
    got = planner.execute(spark, node, messages=messages(spark, [(3, 1), (12, 1), (14, 2), (35, 1)]))["count"]
    rows = [(r["key"], r["seq"], json.loads(r["payload"])["count"]) for r in got.where("message_type = 'total'").orderBy("key", "seq").collect()]
    assert rows == [("1", 10, 1), ("1", 20, 2), ("1", 30, 2), ("2", 20, 1), ("2", 30, 1), ("7", 10, 0), ("7", 20, 0), ("7", 30, 0)]
    assert sorted(r["key"] for r in got.where("kind = 'created'").collect()) == ["1", "2", "7"]


def test_a_node_without_messages_and_wrong_schedules(spark):
    node = Node.builder("a").default_routing("managed").receiver().cluster("count").mp(samples.Counter()).build()
    with pytest.raises(TopologyError):
        planner.execute(spark, node)
    assert planner.execute(spark, node, messages=messages(spark, [(1, 1)]).limit(0))["count"].count() == 0
    cron = Node.builder("a").default_routing("managed").receiver().cluster("count").mp(samples.Counter()).output_every("0 0 * * * ?").build()
    with pytest.raises(TopologyError):
        planner.execute(spark, cron, messages=messages(spark, [(1, 1)]))


def test_a_class_below_the_handled_one_travels(spark):
    got = imperative(spark.createDataFrame([("event", "1", to_json(samples.Click(1, 1)), 1), ("event", "1", to_json(samples.Event(2, 1)), 2)], ENVELOPE), Processor.of(samples.ByClass()))
    assert sorted(json.loads(r["payload"])["handler"] for r in got.where("kind = 'message'").collect()) == ["general", "parent"]


def test_fixpoints(spark):
    first = spark.range(100).select("id", (F.col("id") % 40).alias("left"))
    got = feedback.fixpoint(first, lambda df: df.where("left > 0").select("id", (F.col("left") - 1).alias("left")))
    assert got.count() == sum(k % 40 + 1 for k in range(100))
    with pytest.raises(RuntimeError):
        feedback.fixpoint(first, lambda df: df, rounds=3)
    assert feedback.fixpoint(first.limit(0), lambda df: df).count() == 0


def test_joins_on_buckets(spark):
    points = spark.range(200).select("id", (F.col("id") * 0.7 - 20).alias("v"))
    bands = spark.createDataFrame([(1, -5.0, 3.0), (2, 3.0, 3.0), (3, 0.0, 90.5), (4, 200.0, 300.0), (5, None, 4.0)], "band int, low double, high double")
    got = {(r["id"], r["band"]) for r in joins.range_join(points, bands, "v", "low", "high", 10.0).collect()}
    assert got == {(k, b) for k in range(200) for b, low, high in ((1, -5, 3), (3, 0, 90.5)) if low <= k * 0.7 - 20 < high}
    left, right = spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("a")), spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") * 5).alias("b"))
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(left, right, ["k"], F.col("a"), F.col("b"), 9).collect())
    assert got == sorted((i * 7, j * 5) for i in range(60) for j in range(60) if i % 3 == j % 3 and abs(i * 7 - j * 5) <= 9)


def test_dispatchers_and_registry(spark):
    d = DispatcherAdaptor()
    d.dispatch_annotated([samples.Event(1, 7), [samples.Event(2, 8)]])
    d.dispatch([TypedMessage("k", {"x": 1}, ("a", "b"))])
    for wrong in (None, [samples.Event(1, 1)]):
        with pytest.raises(ValueError):
            d.dispatch(wrong)
    d.stop()
    d.dispatch_annotated(samples.Event(3, 9))
    assert d.dropped == 1
    rows = d.read(spark).collect()
    assert [(r["message_type"], r["key"], r["seq"]) for r in rows] == [("event", "7", 0), ("event", "8", 1), ("a", "k", 2), ("b", "k", 3)]
    dummy = DummyDispatcher()
    dummy.dispatch_annotated(samples.Event(1, 1))
    assert dummy.dropped == 1
    assert from_json_messages(json_messages(d.read(spark))).collect() == rows
    null_sink(d.read(spark))
    assert isinstance(ADAPTORS.get("dispatcher.some.more"), DispatcherAdaptor)
    with pytest.raises(KeyError):
        Registry().get("none")


def test_shedding_drops_the_oldest_queued_and_the_newest_beyond(spark):
    df = spark.range(10).select(F.lit(1).alias("b"), "id")
    gone = lambda most: sorted(r["id"] for r in shedding.shed(df, "b", "id", most).where("discarded").collect())
    assert gone(4) == [0, 1, 2, 3, 8, 9] and gone(10) == [] and gone(0) == [] and gone(6) == [0, 1, 2, 3]


def test_deliveries_and_empty_input(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, message_types array<string>")
    assert sorted((r["id"], r["cluster"]) for r in routing.deliveries(df, {"a": ["x"], "b": ["x", "y"]}).collect()) == [(1, "x"), (1, "x"), (1, "y")]
    none = messages(spark, [(1, 1)]).limit(0)
    assert imperative(none, samples.counter()).count() == 0
    assert lifecycle.lives(spark.createDataFrame([], "k int, ts timestamp"), "k", "ts", 5).count() == 0
    nested = spark.createDataFrame([(1, [[1, None], None, []])], "id int, v array<array<int>>")
    assert [r["v"] for r in fanout.unwound(nested, "v", 2).collect()] == [1]


def test_observed_counters(spark):
    df, seen = metrics.observed(messages(spark, [(i, 1) for i in range(5)]), "seen")
    null_sink(df)
    assert seen.get == {"received": 5, "without_key": 0}


def test_node_counters(spark):
    df = spark.createDataFrame([(["a"], False), (["a", "b"], False), (["c"], False), (["b"], True), (None, False)], "types array<string>, gone boolean")
    got = metrics.node_counts(routing.receiving(df, {"a": ["x", "y"], "b": ["x"]}, F.col("types")), discarded="gone").first()
    assert got.asDict() == {"received": 5, "discarded": 1, "sent": 5, "not_sent": 2}


def test_passes_that_repeat_are_folded_and_their_methods_not_called(spark):
    class Outs(Mp):
        def __init__(self):
            self.n, self.calls = 0, 0

        def handle(self, message):
            self.n += 1
            self.fresh = 3

        def output(self):
            if self.fresh:
                self.fresh -= 1
            return TypedMessage("k", {"n": self.n, "fresh": self.fresh}, ("out",))

    node = Node.builder("a").default_routing("managed").receiver().cluster("c").mp(MpFactory.make(Outs, "event", outputs=True)).output_every(10).build()
    rows = messages(spark, [(1, 1), (2001, 1), (10_000, 2)])
    want = [(k, s, n, f) for k, begin, end, n in ((1, 0, 200, 1), (1, 200, 1000, 2), (2, 1000, 1000, 1)) for s, f in ((10 * (begin + i + 1), max(2 - i, 0)) for i in range(end - begin))]
    read = lambda r: (r["seq"], json.loads(r["payload"])["n"], json.loads(r["payload"])["fresh"])
    got = planner.execute(spark, node, messages=rows)["c"]
    assert sorted(map(read, got.where("message_type = 'out'").collect())) == [w[1:] for w in want] and got.columns == NAMES
    assert metrics.timers(got).where("timer = 'output'").first()["passes"] == len(want)
    folded = planner.execute(spark, node, messages=rows, kinds=("message",), fold=True)["c"]
    assert folded.count() < 20 and {r["kind"] for r in folded.collect()} == {"message"}
    assert sorted(map(read, unfolded(folded, 10).collect())) == [w[1:] for w in want]


def test_checks_between_passes_that_repeat(spark):
    got = kinds(imperative(messages(spark, [(0, 1), (1, 1), (2, 2), (3000, 1), (3000, 2)]), samples.evicting(2), output_span=10, evict_span=500, end=6000))
    # key 1 goes at 500 after 50 passes, comes back at 3000 and stays; key 2 goes at 3500
    assert got["evicted"] == 1 + 1 and got["message"] == 5 + 50 + 300 + 300 + 50


def test_a_digest_in_order_costs_what_its_parts_do(monkeypatch):
    fed, own = [], hashlib.md5

    class Counted:
        def __init__(self, raw=b""):
            self.md5 = own()
            self.update(raw)

        def update(self, raw):
            fed.append(len(raw))
            self.md5.update(raw)

        def hexdigest(self):
            return self.md5.hexdigest()

    monkeypatch.setattr(samples.hashlib, "md5", Counted)
    made, text = samples.InOrder(), "".join(f"{k % 12}," for k in range(3000)).encode()
    for k in range(1500):
        made.take(samples.Part("a", k % 12))
    made = cloudpickle.loads(cloudpickle.dumps(made))  # as state between rounds and micro-batches
    for k in range(1500, 3000):
        last = made.take(samples.Part("a", k % 12))
    assert (last.parts, last.md5) == (3000, own(text).hexdigest()) and sum(fed) <= 2 * len(text)


def test_only_the_kinds_asked_for_return(spark):
    node = Node.builder("a").default_routing("managed").receiver().cluster("burst").mp(samples.Burst()).cluster("in_order").mp(samples.InOrder()).build()
    rows = messages(spark, [(i, i % 2) for i in range(6)])
    whole, some = run(Topology(node), rows), run(Topology(node), rows, kinds=("processed",))
    for c in ("burst", "in_order"):
        assert sorted(map(str, some[c].collect())) == sorted(map(str, whole[c].where("kind = 'processed'").collect()))
    assert kinds(imperative(rows, samples.counter(), kinds=("created", "message"))) == {"created": 2, "message": 6}

"""Queries over the supplied tables, each with the SQL that checks it.

Those under EXTENSIONS render relational needs that the keyed model leaves to handlers, with what Spark has for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import shard_of
from keyloom.functions import vectors
from keyloom.model import KeyExtractor, ModelError, TypedMessage, message_key, message_type
from keyloom.operators import fanout, feedback, joins, keyed, lifecycle, metrics, routing, shards, shedding
from keyloom.plans import planner, samples
from keyloom.plans.batch import Declarative, envelope, imperative, run, sent
from keyloom.processor import Processor, message_handler, mp, passivation
from keyloom.sources.adaptors import ADAPTORS, SINKS, DispatcherAdaptor, DummyDispatcher, TableAdaptor, from_json_messages, json_messages, stream_sink
from keyloom.storage import scratch
from keyloom.streaming import stateful, windows
from keyloom.streaming.schedules import Cron, Every
from keyloom.topology import Cluster, Node, Topology, TopologyError

#: Java's white space.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SQL_WORDS = r"(SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents)"
IDLE = 6 * 3600
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.split("text", SPACE)
    return table(spark, sf_dir, "documents").select(F.explode(split).alias("word")).where("word <> ''")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages `event`, keyed by user and ordered by event_id."""
    return TableAdaptor(f"{sf_dir}/events.parquet", "event", "user_id", "event_id", "event_id", "user_id", "event_type", "value").read(spark)


# Sources, keys and fan-out


@registered("SELECT 'event' AS message_type, user_id::VARCHAR AS key, event_id AS seq, event_type, value FROM events WHERE user_id IS NOT NULL")
def adaptor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = event_messages(spark, sf_dir)
    own = F.from_json("payload", "event_type string, value double")
    return read.select("message_type", "key", "seq", own["event_type"].alias("event_type"), own["value"].alias("value"))


@registered("SELECT 'event' AS message_type, user_id::VARCHAR AS key, event_id AS seq, event_type FROM events WHERE user_id IS NOT NULL")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = from_json_messages(json_messages(event_messages(spark, sf_dir)))
    return back.select("message_type", "key", "seq", F.get_json_object("payload", "$.event_type").alias("event_type"))


@registered("SELECT fmt, count(*) AS messages, count(DISTINCT user_id) AS keys, sum(event_id)::BIGINT AS ids FROM events CROSS JOIN (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS v(fmt) GROUP BY fmt")
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by the registered sink and read by the registered adaptor, in four formats."""
    at, rows = scratch(spark, "formats"), events(spark, sf_dir).select("event_id", "user_id", "event_type")
    found = []
    for fmt in ("parquet", "orc", "json", "csv"):
        SINKS.get(f"table.{fmt}")(rows, f"{at}/{fmt}", fmt)
        back = ADAPTORS.get(f"table.{fmt}", f"{at}/{fmt}", "event", "user_id", "event_id", "event_type", fmt=fmt, schema="event_id long, user_id long, event_type string").read(spark)
        found.append(back.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("messages"), F.countDistinct("key").alias("keys"), F.sum("seq").alias("ids")))
    return planner.together(found)


@registered("""
SELECT message_type, key, count(*) AS n, 1::BIGINT AS late, (SELECT count(*) FROM nation) AS nowhere FROM (
SELECT 'region' AS message_type, r_regionkey::VARCHAR AS key FROM region UNION ALL SELECT 'nation', n_regionkey::VARCHAR FROM nation
UNION ALL SELECT 'pair(even)', CASE WHEN n_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END FROM nation
UNION ALL SELECT 'pair(odd)', CASE WHEN n_nationkey % 2 = 1 THEN 'yes' ELSE 'no' END FROM nation) GROUP BY message_type, key""")
def dispatched_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the driver pushes: explicit ones, a list of them, objects by their class, one after the end; and into nothing.

    The tables are the fixed ones of 5 and 25 rows: a dispatcher is no way for a corpus.
    """
    pushed, nowhere = DispatcherAdaptor(), DummyDispatcher()
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():
        pushed.dispatch(TypedMessage(r.r_regionkey, {"region": r.r_regionkey}, ("region",)))
    of_region = [TypedMessage(n.n_regionkey, {"nation": n.n_nationkey}, ("nation",)) for n in nations]
    pushed.dispatch(of_region), nowhere.dispatch(of_region)
    for n in nations:
        pushed.dispatch_annotated(samples.Pair(n.n_nationkey))
    pushed.stop()
    pushed.dispatch(TypedMessage(0, {"region": 0}, ("region",)))
    read = pushed.read(spark)
    SINKS.get("null")(read)
    late, none = F.lit(pushed.dropped).cast("long"), F.lit(nowhere.dropped).cast("long")
    return read.groupBy("message_type", "key").agg(F.count("*").alias("n")).select("*", late.alias("late"), none.alias("nowhere"))


@registered("SELECT event_id, t AS message_type FROM events CROSS JOIN (VALUES ('event'), ('audit'), ('billing')) AS v(t)")
def multi_type_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.by_types(events(spark, sf_dir).select("event_id"), ["event", "audit", "billing"])


@registered("""
SELECT event_id, 'number(even)' AS message_type, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS message_key FROM events
UNION ALL SELECT event_id, 'number(odd)', CASE WHEN event_id % 2 = 1 THEN 'yes' ELSE 'no' END FROM events""")
def multi_key_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no")
    odd = F.when(F.col("event_id") % 2 == 1, "yes").otherwise("no")
    return fanout.by_keys(events(spark, sf_dir).select("event_id"), "number", {"even": even, "odd": odd})


@registered("""
SELECT cluster, message_key, count(*) AS handled FROM (
SELECT 'even' AS cluster, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS message_key FROM events
UNION ALL SELECT 'odd', CASE WHEN event_id % 2 = 1 THEN 'yes' ELSE 'no' END FROM events) GROUP BY ALL""")
def even_odd_dual_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent_ = multi_key_fanout(spark, sf_dir)
    receivers = {"number(even)": ["even"], "number(odd)": ["odd"]}
    given = routing.deliveries(sent_.withColumn("message_types", F.array("message_type")), receivers)
    return given.groupBy("cluster", "message_key").agg(F.count("*").alias("handled"))


@registered("""
SELECT 'evens' AS cluster, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS key, count(*) AS handled FROM events GROUP BY ALL
UNION ALL SELECT 'odds', CASE WHEN event_id % 2 = 1 THEN 'yes' ELSE 'no' END, count(*) FROM events GROUP BY ALL""")
def discriminated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message with two keys; each of two handlers selects the one that addresses it."""
    node = Node.builder("sample").default_routing("managed").receiver().cluster("pairing").mp(samples.Pairing()).cluster("evens").mp(samples.Evens()).cluster("odds").mp(samples.Odds()).build()
    found = run(Topology(node), event_messages(spark, sf_dir), kinds=("processed",))
    each = planner.together([found[c].where("kind = 'processed'").select(F.lit(c).alias("cluster"), "key") for c in ("evens", "odds")])
    return each.groupBy("cluster", "key").agg(F.count("*").alias("handled"))


@registered("""
SELECT message_type, count(*) AS n, sum(value) AS total FROM (
SELECT event_type AS message_type, value FROM events
UNION ALL SELECT 'interaction', value FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'event', value FROM events WHERE event_type IN ('click', 'view', 'purchase')) GROUP BY ALL""")
def subtype_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = {"click": ["interaction", "event"], "view": ["interaction", "event"], "purchase": ["event"]}
    each = fanout.with_supertypes(events(spark, sf_dir).select("event_type", "value"), "event_type", parents)
    return each.groupBy("message_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@registered(f"SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(string_split(line, ' '), lambda w: w)) AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE word <> '' GROUP BY word")
def unwind_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that returns lines of words, a list of lists."""
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    each = fanout.unwound(table(spark, sf_dir, "documents").select(nested.alias("word")), "word", 2)
    return each.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@registered("SELECT count(*) FILTER (WHERE key IS NOT NULL) AS sent, count(*) FILTER (WHERE key IS NULL) AS dropped FROM (SELECT json_extract_string(props, '$.k') AS key FROM events)")
def unkeyed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events(spark, sf_dir).select(F.get_json_object("props", "$.k").alias("key"))
    return keys.agg(F.count_if(fanout.has_key("key")).alias("sent"), F.count_if(~fanout.has_key("key")).alias("dropped"))


# Routing


@registered("SELECT event_type, count(*) AS n, event_type IN ('click', 'view', 'purchase') AS handled FROM events GROUP BY event_type")
def type_routing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("event_type")
    return events(spark, sf_dir).groupBy(own).agg(F.count("*").alias("n")).withColumn("handled", routing.is_handled(["click", "view", "purchase"], "event_type"))


@registered("SELECT count(*) AS received, 0::BIGINT AS discarded, (2 * count(*) FILTER (WHERE event_type = 'click') + count(*) FILTER (WHERE event_type IN ('view', 'purchase')))::BIGINT AS sent, count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase')) AS not_sent FROM events")
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's counters: clicks go to two clusters, views and purchases to one, the rest to none."""
    receivers = {"click": ["a", "b"], "view": ["a"], "purchase": ["b"]}
    return metrics.node_counts(routing.receiving(events(spark, sf_dir), receivers, F.array("event_type")))


@registered("SELECT c AS cluster, count(*) AS handled FROM events JOIN (VALUES ('a','event'), ('a','audit'), ('b','audit')) AS v(c, t) ON t IN ('event', 'audit') GROUP BY c")
def duplicate_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster a handles both types of each message, and so each message twice."""
    typed = events(spark, sf_dir).select("event_id", F.array(F.lit("event"), F.lit("audit")).alias("message_types"))
    return routing.deliveries(typed, {"event": ["a"], "audit": ["a", "b"]}).groupBy("cluster").agg(F.count("*").alias("handled"))


SQL_HOPS = """
WITH RECURSIVE r AS (SELECT event_id, event_id % 7 AS hops FROM events UNION ALL SELECT event_id, hops - 1 FROM r WHERE hops > 0)
SELECT hops, count(*) AS handled FROM r GROUP BY hops"""


@registered(SQL_HOPS)
def feedback_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster that sends to itself until a message has no hops left, run by the library's loop until nothing is pending."""
    node = Node.builder("sample").default_routing("managed").receiver().cluster("hop").mp(samples.Hopper()).build()
    first = envelope(events(spark, sf_dir).withColumn("hops", F.col("event_id") % 7), "hop", "user_id", "event_id", "user_id", "hops")
    seen = run(Topology(node), first, kinds=("message",))["hop"].where("kind = 'message' AND message_type = 'seen'")
    return seen.groupBy(F.get_json_object("payload", "$.hops").cast("long").alias("hops")).agg(F.count("*").alias("handled"))


@registered(SQL_HOPS)
def feedback_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same loop as rounds of a table."""
    first = events(spark, sf_dir).select("event_id", (F.col("event_id") % 7).alias("hops"))
    found = feedback.fixpoint(first, lambda df: df.where("hops > 0").select("event_id", (F.col("hops") - 1).alias("hops")))
    return found.groupBy("hops").agg(F.count("*").alias("handled"))


@registered("SELECT user_id::VARCHAR AS user_id, (12 * count(*))::BIGINT AS parts, md5(string_agg('0,1,2,3,4,5,6,7,8,9,10,11,', '' ORDER BY event_id)) AS md5 FROM events GROUP BY user_id")
def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve results of each message come to the next cluster in their order."""
    node = Node.builder("sample").default_routing("managed").receiver().cluster("burst").mp(samples.Burst()).cluster("in_order").mp(samples.InOrder()).build()
    found = sent(run(Topology(node), event_messages(spark, sf_dir), kinds=("message",))["in_order"])
    last = found.groupBy(F.col("key").alias("user_id")).agg(F.max_by("payload", F.struct("seq", "place")).alias("payload"))
    return last.select("user_id", F.get_json_object("payload", "$.parts").cast("long").alias("parts"), F.get_json_object("payload", "$.md5").alias("md5"))


@registered("""
WITH o AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
c AS (SELECT o_custkey, sum(quantity) AS quantity FROM o JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT n_name, sum(quantity) AS quantity, count(*) AS customers FROM c JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def three_stage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to orders to customers to nations: each stage keeps a sum for its key."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = items.join(orders, items.l_orderkey == orders.o_orderkey).groupBy("o_custkey").agg(F.sum("quantity").alias("quantity"))
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(own, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("customers"))


@registered("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def group_colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages of one key share the exchange of the first: a count by user and type after dealing by user."""
    dealt = routing.grouped(events(spark, sf_dir).select("user_id", "event_type"), "user_id")
    return dealt.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# Keyed state


@registered(f"SELECT word, count(*) - 1 AS rank FROM {SQL_WORDS} WHERE word <> '' GROUP BY word")
def word_count_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.final_count(words(spark, sf_dir), "word").withColumnRenamed("last_count", "rank")


@registered(f"SELECT word, count(*) - 1 AS rank FROM {SQL_WORDS} WHERE word <> '' GROUP BY word ORDER BY rank DESC, word LIMIT 10")
def word_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.sorted_pairs(keyed.top_k(word_count_final(spark, sf_dir), "word", "rank"), "word", "rank")


@registered("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS running_count FROM events")
def running_count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.running_count(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@registered("SELECT user_id::VARCHAR AS user_id, count(*) - 1 AS last_count FROM events GROUP BY user_id")
def running_count_imperative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counter as a Python class, its results put by a second one: declarative and imperative forms agree."""
    counts = imperative(event_messages(spark, sf_dir), samples.counter())
    return sent(counts).groupBy("key").agg(F.max_by(F.get_json_object("payload", "$.count").cast("long"), "seq").alias("last_count")).withColumnRenamed("key", "user_id")


@registered("SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def last_value_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.last_value(events(spark, sf_dir), "user_id", "value", "event_id")


@registered("SELECT user_id, max(value) AS max_value FROM events GROUP BY user_id")
def keep_max_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_max(events(spark, sf_dir), "user_id", "value")


@registered("SELECT count(*) AS messages, count(DISTINCT user_id) AS instances, max(value) AS largest FROM events")
def shared_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.global_table(events(spark, sf_dir), F.count("*").alias("messages"), F.countDistinct("user_id").alias("instances"), F.max("value").alias("largest"))


@registered("SELECT count(DISTINCT user_id) AS created FROM events")
def instances_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = imperative(event_messages(spark, sf_dir), samples.counter())
    return made.agg(F.count_if(F.col("kind") == "created").alias("created"))


@registered("SELECT custkey, count(*) FILTER (WHERE t = 'customer') AS profiles, count(*) FILTER (WHERE t = 'order') AS orders, sum(price) AS spent FROM (SELECT c_custkey AS custkey, 'customer' AS t, NULL AS price FROM customer UNION ALL SELECT o_custkey, 'order', o_totalprice FROM orders) GROUP BY custkey")
def two_type_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two message types with one state: a profile and its orders."""
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"))
    both = keyed.cogroup({"customer": profiles, "order": orders}, "custkey")
    of = lambda t: F.count_if(F.col("message_type") == t)
    return both.groupBy("custkey").agg(of("customer").alias("profiles"), of("order").alias("orders"), F.sum("price").alias("spent"))


@registered("SELECT user_id::VARCHAR AS user_id, count(*) AS handled, (count(*) + 999) // 1000 AS piles FROM events GROUP BY user_id")
def bulk_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk handler gets what has piled up for its key, 1000 messages at most, and emits once for each pile."""
    got = sent(imperative(event_messages(spark, sf_dir), samples.bulk_counter(), bulk=True))
    return got.groupBy(F.col("key").alias("user_id")).agg(F.sum(F.get_json_object("payload", "$.count").cast("long")).alias("handled"), F.count("*").alias("piles"))


@registered("SELECT user_id::VARCHAR AS user_id, count(*) AS results, count(*) - 1 AS last_count FROM events GROUP BY user_id")
def bulk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles for a processor without a bulk handler: its handler gets their messages in turn."""
    got = sent(imperative(event_messages(spark, sf_dir), samples.counter(), bulk=True))
    return got.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("results"), F.max(F.get_json_object("payload", "$.count").cast("long")).alias("last_count"))


@registered("SELECT user_id::VARCHAR AS user_id, CASE WHEN event_type = 'purchase' THEN 'exact' WHEN event_type IN ('click', 'view') THEN 'parent' ELSE 'general' END AS handler, count(*) AS n FROM events GROUP BY ALL")
def polymorphic_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events come as one type; a message's class picks its handler: its own, else that of the nearest class above it."""
    t = F.col("event_type")
    cls = F.when(t == "purchase", "Purchase").when(t == "click", "Click").when(t == "view", "Interaction").otherwise("Event")
    rows = events(spark, sf_dir).withColumn("__class__", F.concat(F.lit(f"{samples.__name__}."), cls))
    got = sent(imperative(envelope(rows, "event", "user_id", "event_id", "event_id", "user_id", "__class__"), Processor.of(samples.ByClass())))
    return got.groupBy(F.col("key").alias("user_id"), F.get_json_object("payload", "$.handler").alias("handler")).agg(F.count("*").alias("n"))


@registered("SELECT user_id::VARCHAR AS user_id, count(*) FILTER (WHERE event_id % 10 <> 3) AS results, count(*) FILTER (WHERE event_id % 10 = 3) AS failed, count(*) AS touched FROM events GROUP BY user_id")
def handler_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that fails on some messages after changing its state: no result, but the change stays, as the last output says."""
    got = imperative(event_messages(spark, sf_dir), samples.failing(), final_output=True).where("key IS NOT NULL")
    of = lambda t: F.col("message_type").eqNullSafe(t) & (F.col("kind") == "message")
    touched = F.max(F.when(of("total"), F.get_json_object("payload", "$.count").cast("long")))
    return got.groupBy(F.col("key").alias("user_id")).agg(F.count_if(of("count")).alias("results"), F.count_if(F.col("kind") == "failed").alias("failed"), touched.alias("touched"))


@registered("SELECT user_id, count(*) AS dispatched, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS processed, sum(value) AS total FROM events GROUP BY user_id")
def handler_errors_declarative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.failing(events(spark, sf_dir), F.col("event_type") == "error", [F.sum("value").alias("total")], "user_id")


@registered("SELECT user_id::VARCHAR AS user_id, count(*) AS calls FROM events GROUP BY user_id")
def functional_processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functional form of a processor, in a topology of two stages."""
    node = Node.builder("sample").default_routing("managed").receiver().cluster("count").mp(samples.functional_counter()).cluster("put").mp(samples.putter()).build()
    found = run(Topology(node), event_messages(spark, sf_dir), kinds=("processed",))["put"]
    return found.where("kind = 'processed'").groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("calls"))


# Lifecycle


@registered("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def activation_first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.first_message(events(spark, sf_dir), "user_id", F.struct("ts", "event_id"), "event_id", "event_type")


@registered("SELECT user_id::VARCHAR AS user_id, 'count' AS cluster, 1::BIGINT AS starts, count(*) AS total FROM events GROUP BY user_id")
def start_and_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prototype starts once, with its cluster's name; its clones share what it learned then, and nothing after."""
    got = sent(imperative(event_messages(spark, sf_dir), Processor.of(samples.Started()), "count"))
    m = F.from_json(F.max_by("payload", "seq"), "cluster string, starts long, count long")
    return got.groupBy(F.col("key").alias("user_id")).agg(m.alias("m")).select("user_id", "m.cluster", "m.starts", F.col("m.count").alias("total"))


@registered("SELECT user_id::VARCHAR AS user_id, (user_id % 5 <> 0)::BIGINT AS created, count(*) FILTER (WHERE user_id % 5 <> 0) AS processed, count(*) FILTER (WHERE user_id % 5 = 0) AS failed FROM events GROUP BY user_id")
def activation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an activation fails there is no instance, and each message of its key counts as failed."""
    got = imperative(event_messages(spark, sf_dir), Processor.of(samples.Choosy())).where("key IS NOT NULL")
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return got.groupBy(F.col("key").alias("user_id")).agg(of("created"), of("processed"), of("failed"))


@registered("""
WITH e AS (SELECT max(event_id) // 1000 AS last FROM events)
SELECT user_id::VARCHAR AS user_id, any_value(last) - min(event_id) // 1000 AS totals, any_value(last) - min(event_id) // 1000 AS again, 0::BIGINT AS unscheduled FROM events, e GROUP BY user_id""")
def output_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two output methods, called at each pass of one cluster; in a cluster without a schedule they never are."""
    node = Node.builder("sample").default_routing("managed").receiver().cluster("timed").mp(samples.Outspoken()).output_every(1000).cluster("silent").mp(samples.Outspoken()).build()
    found = planner.execute(spark, node, messages=event_messages(spark, sf_dir), kinds=("created", "message"), fold=True)
    each = planner.together([found[c].where("key IS NOT NULL").withColumn("cluster", F.lit(c)) for c in ("timed", "silent")])
    total, n = F.col("message_type").eqNullSafe("total") & (F.col("kind") == "message"), F.get_json_object("payload", "$.count").cast("long")
    timed = F.col("cluster") == "timed"
    passes_of = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("times"))), F.lit(0)).cast("long")
    counted = passes_of(total & timed & (n > 0)).alias("totals"), passes_of(total & timed & (n < 0)).alias("again"), passes_of(total & ~timed).alias("unscheduled")
    return each.groupBy(F.col("key").alias("user_id")).agg(*counted)


def passes(spark: SparkSession, sf_dir: str, schedule: Cron | Every) -> DataFrame:
    """The moments at which a schedule calls, between the first and the last event, and how many events came before each.

    Events are counted by hour before they meet the moments, whose number is that of the schedule's, not of the rows.
    """
    own = events(spark, sf_dir).where("ts IS NOT NULL")
    low, high = own.agg(F.min("ts"), F.max("ts")).first()
    dues, now = [], low and (low.replace(minute=0, second=0, microsecond=0) - timedelta(seconds=1) if isinstance(schedule, Cron) else low.replace(hour=0, minute=0, second=0, microsecond=0))
    while now and (now := schedule.after(now)) and now <= high:
        dues.append(now)
    moments = spark.createDataFrame([(str(d),) for d in dues], "due string").select(F.col("due").cast("timestamp_ntz").alias("due"))
    hours = own.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    both = moments.select("due", F.lit(True).alias("is_due"), F.lit(0).cast("long").alias("n")).union(hours.select(F.col("hour").alias("due"), F.lit(False), "n"))
    upto = Window.orderBy("due", F.desc("is_due")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # hours and moments, not events
    return both.withColumn("handled", F.sum("n").over(upto)).where("is_due").select("due", "handled")


@registered("""
WITH e AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS low, min(ts) AS first, max(ts) AS high FROM events),
d AS (SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS due, first, high FROM e)
SELECT due, (SELECT count(*) FROM events WHERE ts < due) AS handled FROM d WHERE due >= date_trunc('hour', first) AND due <= high AND hour(due) IN (6, 18) AND isodow(due) <= 5""")
def cron_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output passes at six and eighteen o'clock from Monday to Friday."""
    return passes(spark, sf_dir, Cron("0 0 6,18 ? * MON-FRI"))


@registered("""
WITH e AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS low, max(ts) AS high FROM events),
d AS (SELECT unnest(generate_series(low + INTERVAL 8 HOUR, high, INTERVAL 8 HOUR)) AS due FROM e)
SELECT due, (SELECT count(*) FROM events WHERE ts < due) AS handled FROM d""")
def relative_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output passes every eight hours."""
    return passes(spark, sf_dir, Every(8, "hours"))


@registered("""
WITH c AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT user_id, unnest(generate_series(min(period), (SELECT max(date_trunc('day', ts))::TIMESTAMP FROM events), INTERVAL 1 DAY)) AS period FROM c GROUP BY user_id)
SELECT user_id, period::DATE AS period, sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY period)::BIGINT AS total FROM g LEFT JOIN c USING (user_id, period)""")
def output_pass_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.output_pass(events(spark, sf_dir), "user_id", "ts").withColumn("period", F.to_date("period"))


SQL_LIVES = f"""
l AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS life FROM (
SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > {IDLE * 1_000_000} THEN 1 ELSE 0 END AS fresh FROM events))"""


@registered(f"WITH {SQL_LIVES} SELECT user_id, life, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS messages, sum(value) AS total FROM l GROUP BY user_id, life")
def evict_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.evicted(events(spark, sf_dir), "user_id", "ts", IDLE, F.sum("value").alias("total"))


@registered(f"""WITH {SQL_LIVES}, s AS (SELECT user_id, life, max(ts) AS last_seen FROM l GROUP BY ALL)
SELECT count(*) AS created, count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT gone) AS live FROM (
SELECT life < max(life) OVER (PARTITION BY user_id) OR epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_seen) > {IDLE * 1_000_000} AS gone FROM s)""")
def passivation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = lifecycle.passivations(events(spark, sf_dir), "user_id", "ts", IDLE)
    return gone.agg(F.count("*").alias("created"), F.count_if("passivated").alias("deleted"), F.count_if(~F.col("passivated")).alias("live"))


SQL_EVICTIONS = """
WITH RECURSIVE c AS (SELECT user_id, event_id // 500 AS p, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT user_id, n, row_number() OVER w AS k, lead(p) OVER w IS NOT NULL AS more FROM c WINDOW w AS (PARTITION BY user_id ORDER BY p)),
r AS (SELECT user_id, k, CASE WHEN n >= 5 AND more THEN 0 ELSE n END AS held, (n >= 5 AND more)::BIGINT AS gone FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN held + n >= 5 AND more THEN 0 ELSE held + n END, (held + n >= 5 AND more)::BIGINT FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
"""


@registered(SQL_EVICTIONS + "SELECT user_id::VARCHAR AS user_id, sum(gone)::BIGINT AS evictions, sum(gone)::BIGINT + 1 AS created FROM r GROUP BY user_id")
def evictable_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate in Python, checked every 500 events: an instance that has had five messages by then goes; the next message finds a fresh one."""
    got = imperative(event_messages(spark, sf_dir), samples.evicting(5), evict_span=500).where("key IS NOT NULL")
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.groupBy(F.col("key").alias("user_id")).agg(of("evicted").alias("evictions"), of("created").alias("created"))


@registered(SQL_EVICTIONS + "SELECT user_id::VARCHAR AS user_id, sum(gone)::BIGINT AS evictions, sum(gone)::BIGINT AS deleted, sum(gone)::BIGINT + 1 AS created FROM r GROUP BY user_id")
def passivation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance whose passivation fails goes all the same."""
    got = imperative(event_messages(spark, sf_dir), Processor.of(samples.Clinging(5)), evict_span=500).where("key IS NOT NULL")
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.groupBy(F.col("key").alias("user_id")).agg(of("evicted").alias("evictions"), of("deleted").alias("deleted"), of("created").alias("created"))


@registered("SELECT p AS predicate, user_id::VARCHAR AS user_id, 0::BIGINT AS evictions, 1::BIGINT AS created FROM events CROSS JOIN (VALUES ('none'), ('fails')) AS v(p) GROUP BY p, user_id")
def eviction_without_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of processors without a predicate, or with one that fails, evict nothing."""
    of = lambda k: F.count_if(F.col("kind") == k)
    got = [imperative(event_messages(spark, sf_dir), p, evict_span=500).where("key IS NOT NULL").withColumn("predicate", F.lit(n)) for n, p in (("none", samples.counter()), ("fails", Processor.of(samples.Undecided())))]
    return planner.together(got).groupBy("predicate", F.col("key").alias("user_id")).agg(of("evicted").alias("evictions"), of("created").alias("created"))


@registered("SELECT user_id::VARCHAR AS user_id, 0::BIGINT AS evictions, 1::BIGINT AS created FROM events GROUP BY user_id")
def eviction_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a frequency nothing is evicted, whatever the predicate says."""
    got = imperative(event_messages(spark, sf_dir), samples.evicting(5))
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.groupBy(F.col("key").alias("user_id")).agg(of("evicted").alias("evictions"), of("created").alias("created"))


@registered("""
WITH c AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT date_trunc('day', max(ts))::TIMESTAMP - INTERVAL 1 DAY AS last FROM events),
g AS (SELECT user_id, unnest(generate_series(min(period), (SELECT last FROM e), INTERVAL 1 DAY)) AS period FROM c GROUP BY user_id)
SELECT user_id::VARCHAR AS user_id, period::DATE AS period, sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY period)::BIGINT AS total FROM g LEFT JOIN c USING (user_id, period)""")
def output_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node with an adaptor and an output each day, as a plan over tables: every instance puts out its count at each midnight."""
    adaptor = TableAdaptor(f"{sf_dir}/events.parquet", "event", "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", "user_id")
    node = Node.builder("sample").default_routing("managed").receiver().cluster("read").adaptor(adaptor).cluster("count").mp(samples.Counter()).output_every(86_400).build()
    got = planner.execute(spark, node, per_second=1e6, kinds=("message",))["count"].where("kind = 'message' AND message_type = 'total'")
    day = F.to_date(F.timestamp_micros(F.col("seq") - 86_400_000_000))
    return got.select(F.col("key").alias("user_id"), day.alias("period"), F.get_json_object("payload", "$.count").cast("long").alias("total"))


@registered("SELECT c_custkey::VARCHAR AS custkey, count(o_orderkey) AS handled, 1::BIGINT AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def keysource_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances for all keys of a table before their first message, in the engine."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    orders = table(spark, sf_dir, "orders").withColumns({"event_id": F.col("o_orderkey"), "user_id": F.col("o_custkey")})
    got = imperative(envelope(orders, "event", "user_id", "event_id", "event_id", "user_id"), samples.counter(), keys=keys)
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.groupBy(F.col("key").alias("custkey")).agg(of("processed").alias("handled"), of("created").alias("created"))


@registered("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def keysource_preinstantiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: customers without an order have an instance too."""
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return lifecycle.preinstantiated(table(spark, sf_dir, "customer").select("c_custkey"), state, "c_custkey", {"orders": 0})


@registered("SELECT user_id::VARCHAR AS user_id, count(*) AS total FROM events GROUP BY user_id")
def restored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: instances passivated with their state go on from it in a second run."""
    messages = event_messages(spark, sf_dir)
    first = imperative(messages.where("seq % 2 = 0"), samples.counter(), keep=True)
    second = imperative(messages.where("seq % 2 = 1"), samples.counter(), keep=True, final_output=True, state=first.where("kind = 'state'"))
    return second.where("kind = 'message' AND message_type = 'total'").select(F.col("key").alias("user_id"), F.get_json_object("payload", "$.count").cast("long").alias("total"))


# Streams


def streamed(results: DataFrame) -> DataFrame:
    """A stream over what is available now, through a durable sink in the shared folder, read back as a table."""
    spark = results.sparkSession
    at = scratch(spark, "stream")
    stream_sink(results, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{at}/out")


def updated(results: DataFrame, key: str) -> DataFrame:
    """A stream of updates over what is available now; the last one of each key."""
    spark = results.sparkSession
    at = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    results.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    return found.groupBy(key).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), "batch").alias("last")).select(key, "last.*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of messages."""
    stateful.use_rocksdb(spark)
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a glob, as a file by itself is no base path
    return envelope(rows, "event", "user_id", "event_id", "event_id", "user_id", "event_type", "value")


@registered("SELECT user_id::VARCHAR AS user_id, count(*) - 1 AS last_count FROM events GROUP BY user_id")
def stream_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter over a stream, its state in the state store."""
    got = streamed(stateful.keyed(event_stream(spark, sf_dir), samples.counter(), kinds=("message",)))
    return got.groupBy(F.col("key").alias("user_id")).agg(F.max(F.get_json_object("payload", "$.count").cast("long")).alias("last_count"))


@registered(SQL_EVICTIONS + ", h AS (SELECT user_id, count(*) AS handled FROM events GROUP BY 1) SELECT user_id::VARCHAR AS user_id, any_value(handled) AS handled, sum(gone)::BIGINT AS evictions FROM r JOIN h USING (user_id) GROUP BY user_id")
def stream_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eviction checks every 500 events over a stream."""
    got = streamed(stateful.keyed(event_stream(spark, sf_dir), samples.evicting(5), evict_span=500, kinds=("processed", "evicted")))
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.groupBy(F.col("key").alias("user_id")).agg(of("processed").alias("handled"), of("evicted").alias("evictions"))


def word_nodes(sf_dir: str, **options) -> Node:
    """Words of the benchmark's texts, counted, the counts kept at their largest, and the ten best."""
    adaptor = samples.WordAdaptor(f"{sf_dir}/benchmar[k].parquet", "item_id", **options)
    return (
        Node.builder("words").default_routing("managed").receiver().cluster("read").adaptor(adaptor)
        .cluster("count").mp(samples.CountWords()).bulk().cluster("keep").mp(samples.KeepMax()).cluster("top").mp(samples.TopTen()).bulk().build()
    )


def best_words(results: DataFrame) -> DataFrame:
    last = sent(results).agg(F.max_by("payload", F.struct("seq", "place")).alias("payload"))
    m = F.from_json("payload", "words array<string>, ranks array<long>")
    return last.select(F.explode(F.arrays_zip(m["words"].alias("word"), m["ranks"].alias("rank"))).alias("w")).select("w.*")


SQL_BEST = r"SELECT word, count(*) - 1 AS rank FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word ORDER BY rank DESC, word LIMIT 10"


@registered(SQL_BEST)
def topology_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters and an adaptor, planned over tables."""
    return best_words(planner.execute(spark, word_nodes(sf_dir))["top"])


@registered(SQL_BEST)
def topology_words_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same node as one streaming query of three stages."""
    stateful.use_rocksdb(spark)
    node = word_nodes(sf_dir, stream=True, schema=table(spark, sf_dir, "benchmark").schema)
    return best_words(streamed(planner.chained(spark, node, ["count", "keep", "top"])))


SQL_LATE = """
WITH s AS (SELECT max(ts) FILTER (WHERE event_id % 4 = 1) - INTERVAL 2 DAY AS mark FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events, s WHERE event_id % 2 = 1 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1"""


@registered(SQL_LATE)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events come first, in two batches, and even ones after them: those of a window that closed two days before are dropped."""
    at = scratch(spark, "late")
    rows = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for k, part in enumerate(("event_id % 4 = 1", "event_id % 4 = 3", "event_id % 2 = 0")):
        rows.where(part).coalesce(1).write.parquet(f"{at}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    got = windows.tumbling(stream, "ts", "1 day", [], {"n": F.count("*")}, late="2 days").drop("window_end")
    return updated(got, "window_start").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@registered("SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases of their user in the six hours after them: two streams with watermarks, their state bounded by them."""
    schema = table(spark, sf_dir, "events").schema

    def side(kind: str, name: str) -> DataFrame:
        rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").where(F.col("event_type") == kind)
        return windows.event_time(rows, "ts").select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "40 days")

    clicks, purchases = side("click", "click"), side("purchase", "purchase")
    on = F.expr("click_user = purchase_user AND purchase_ts > click_ts AND purchase_ts <= click_ts + interval 6 hours")
    return streamed(clicks.join(purchases, on).select("click", "purchase"))


# Shards


@registered("SELECT DISTINCT user_id, (514229 * user_id) & 255 AS shard FROM events")
def shard_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_shard(events(spark, sf_dir).select("user_id").distinct(), "user_id")


@registered("""
SELECT event_type, (514229 * list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (h * 31 + x) % 256)) & 255 AS shard
FROM (SELECT DISTINCT event_type FROM events)""")
def shard_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_shard(events(spark, sf_dir).select("event_type").distinct(), "event_type", text=True)


@registered("SELECT (514229 * user_id) & 15 AS shard, count(*) AS messages, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def shard_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(shard_of(F.col("user_id"), shards=16).alias("shard")).agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("keys"))


@registered("SELECT nodes, rank, 256 // greatest(nodes, 3) + CASE WHEN rank < 256 % greatest(nodes, 3) THEN 1 ELSE 0 END AS shards FROM (SELECT nodes, unnest(range(nodes)) AS rank FROM range(1, 11) AS t(nodes))")
def shard_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.quotas(spark.range(1, 11).toDF("nodes"), 256, 3)


@registered("SELECT CASE WHEN s < 6 THEN 'n0' WHEN s < 11 THEN 'n1' ELSE 'n2' END AS node, count(*) AS messages FROM (SELECT (514229 * user_id) & 15 AS s FROM events) GROUP BY 1")
def managed_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = shards.allocate(16, ["n0", "n1", "n2"])
    return shards.routed(events(spark, sf_dir), given, "user_id", shards=16).groupBy("node").agg(F.count("*").alias("messages"))


@registered("SELECT count(*) FILTER (WHERE s < 8) AS sent, count(*) FILTER (WHERE s >= 8) AS not_sent FROM (SELECT (514229 * user_id) & 15 AS s FROM events)")
def unassigned_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose shard has no owner aren't sent."""
    given = shards.routed(events(spark, sf_dir), {"n0": range(8)}, "user_id", shards=16)
    return given.agg(F.count_if(F.col("node").isNotNull()).alias("sent"), F.count_if(F.col("node").isNull()).alias("not_sent"))


@registered("SELECT DISTINCT user_id, (514229 * user_id) & 15 AS shard FROM events WHERE (514229 * user_id) & 15 BETWEEN 4 AND 7")
def owned_after_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.evicted_by_shrink(events(spark, sf_dir), "user_id", range(8), range(4), shards=16)


# Shedding and counters


@registered("""
SELECT batch, count(*) AS received, count(*) FILTER (WHERE discarded) AS discarded FROM (
SELECT batch, place > 80 OR place <= least(n, 80) - 40 AS discarded FROM (
SELECT date_trunc('day', ts)::DATE AS batch, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) AS place, count(*) OVER (PARTITION BY date_trunc('day', ts)) AS n FROM events)) GROUP BY batch""")
def shed_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", F.to_date("ts").alias("batch"))
    return shedding.shed(own, "batch", "event_id", 40).groupBy("batch").agg(F.count("*").alias("received"), F.count_if("discarded").alias("discarded"))


@registered("SELECT date_trunc('day', ts)::DATE AS batch, count(*) AS received, 0::BIGINT AS discarded FROM events GROUP BY 1")
def unlimited_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 0 is none, on a node and on a container."""
    own = events(spark, sf_dir).select("event_id", F.to_date("ts").alias("batch"))
    free = shedding.shed(own, "batch", "event_id", 0).withColumnRenamed("discarded", "shed")
    gone = F.count_if(F.col("shed") | F.col("discarded"))
    return shedding.limited(free, "batch", "event_id", -1).groupBy("batch").agg(F.count("*").alias("received"), gone.alias("discarded"))


@registered("SELECT user_id, least(count(*), 20) AS accepted FROM events GROUP BY user_id")
def container_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = shedding.limited(events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 20)
    return kept.groupBy("user_id").agg(F.count_if(~F.col("discarded")).alias("accepted"))


@registered("SELECT count(*) AS dispatched, count(*) FILTER (WHERE event_id % 10 <> 3) AS processed, count(*) FILTER (WHERE event_id % 10 = 3) AS failed, count(DISTINCT user_id) AS created, 0::BIGINT AS deleted, 0::BIGINT AS evicted, 0::BIGINT AS unkeyed, 0::BIGINT AS unsent, 0::BIGINT AS output_failed, count(*) FILTER (WHERE event_id % 10 <> 3) AS sent, 0::BIGINT AS collisions, 0::BIGINT AS discarded FROM events")
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_counts(imperative(event_messages(spark, sf_dir), samples.failing()))


@registered("""
WITH p AS (SELECT *, place > 80 OR place <= least(n, 80) - 40 AS gone FROM (
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events))
SELECT count(*) AS received, count(*) FILTER (WHERE gone) AS discarded, count(*) FILTER (WHERE NOT gone) AS dispatched, count(*) FILTER (WHERE NOT gone AND event_id % 10 <> 3) AS processed,
count(*) FILTER (WHERE NOT gone AND event_id % 10 = 3) AS failed, count(DISTINCT user_id) FILTER (WHERE NOT gone) AS live, true AS received_balance, true AS handled_balance FROM p""")
def metric_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the input and of what shedding drops, against those that the cluster's own rows give."""
    own = shedding.shed(event_messages(spark, sf_dir), "key", "seq", 40)
    kept = own.where("NOT discarded")
    given = own.agg(F.count("*").alias("received"), F.count_if("discarded").alias("discarded"))
    own_counts = metrics.cluster_counts(imperative(kept, samples.failing(), final_output=True, keep=True)).drop("discarded")
    both = given.crossJoin(own_counts)  # one row each
    return both.select(
        "received", "discarded", "dispatched", "processed", "failed", (F.col("created") - F.col("deleted")).alias("live"),
        (F.col("received") == F.col("discarded") + F.col("dispatched")).alias("received_balance"), (F.col("dispatched") == F.col("processed") + F.col("failed")).alias("handled_balance"),
    )


# EXTENSIONS: event-time windows and relational forms


@registered("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.tumbling(events(spark, sf_dir), "ts", "1 day", ["event_type"], {"n": F.count("*"), "total": F.sum("value")})
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@registered("SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY w")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.sliding(events(spark, sf_dir), "ts", "12 hours", "6 hours", [], {"n": F.count("*")})
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@registered(f"WITH {SQL_LIVES.replace('> ' + str(IDLE * 1_000_000), '>= ' + str(IDLE * 1_000_000))} SELECT user_id, min(ts) AS window_start, count(*) AS n FROM l GROUP BY user_id, life")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.sessions(events(spark, sf_dir), "ts", f"{IDLE} seconds", ["user_id"], {"n": F.count("*")})
    return got.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@registered("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def relational_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"))


@registered("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def relational_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, s, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    joined = c.join(o, c.c_custkey == o.o_custkey).join(l, o.o_orderkey == l.l_orderkey).join(s, (l.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def relational_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def relational_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@registered("SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id < e.event_id) AS last_purchase FROM events e WHERE e.event_type = 'click'")
def relational_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each click of a user: one ordered window over both, in place of a range join."""
    own = events(spark, sf_dir).where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return own.withColumn("last_purchase", F.last(bought, ignorenulls=True).over(w)).where("event_type = 'click'").select("event_id", "last_purchase")


@registered("SELECT n_regionkey, c_mktsegment, count(*) AS n, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def relational_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@registered("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def relational_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@registered("SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def relational_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")).intersect(rich)


@registered("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def relational_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.get_json_object("props", "$.k")).alias("kinds"))


@registered("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running_total, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running_max FROM events")
def running_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declarative processor with two state variables, emitted after each message."""
    fold = Declarative({"running_total": F.sum("value"), "running_max": F.max("value")})
    return fold.lower(events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "running_total", "running_max")


@registered("SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def relational_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")).union(rich).distinct()


@registered("SELECT c_custkey AS custkey, c_nationkey % 3 AS rest FROM customer EXCEPT SELECT o_custkey, 0 FROM orders")
def relational_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), (F.col("c_nationkey") % 3).alias("rest"))
    return own.subtract(table(spark, sf_dir, "orders").select("o_custkey", F.lit(0)))


@registered("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority)::INT AS no_priority FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus), ())")
def relational_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, p, s = table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return own.groupingSets([[p, s], [s], []], p, s).agg(F.count("*").alias("n"), F.grouping(p).cast("int").alias("no_priority"))


@registered("SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice >= 900 + 40 * n_nationkey AND p_retailprice < 960 + 40 * n_nationkey")
def relational_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the price bands of nations, some of which overlap."""
    bands = table(spark, sf_dir, "nation").select("n_nationkey", (900.0 + 40 * F.col("n_nationkey")).alias("low"), (960.0 + 40 * F.col("n_nationkey")).alias("high"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(parts, bands, "p_retailprice", "low", "high", 60.0).select("p_partkey", "n_nationkey")


@registered("SELECT a.event_id AS error, b.event_id AS near FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'error' AND b.event_type <> 'error'")
def relational_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did within an hour of an error."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events(spark, sf_dir).select("user_id", "event_id", "event_type", at.alias("at"))
    errors = own.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), "at")
    others = own.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("near"), F.col("at").alias("other"))
    return joins.interval_join(errors, others, ["user_id"], F.col("at"), F.col("other"), 3_600_000_000).select("error", "near")


@registered("""
SELECT o_orderkey, upper(o_orderstatus) || '-' || substr(o_orderpriority, 1, 1) AS code, length(o_orderpriority) AS size, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter,
date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate))::INT AS days, floor(o_totalprice)::BIGINT AS whole, abs(o_totalprice - 150000) > 50000 AS far, coalesce(nullif(o_orderstatus, 'O'), '?') AS status,
regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS letters, greatest(o_custkey, o_orderkey) AS larger, CASE WHEN o_orderkey % 3 = 0 THEN 'fizz' ELSE 'no' END AS fizz FROM orders""")
def relational_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions on texts, times and numbers, all within generated code."""
    p, s, d, t = (F.col(f"o_{c}") for c in ("orderpriority", "orderstatus", "orderdate", "totalprice"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.upper(s), F.lit("-"), F.substring(p, 1, 1)).alias("code"), F.length(p).alias("size"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        F.date_diff(F.to_date(d), F.lit("1992-01-01").cast("date")).alias("days"), F.floor(t).alias("whole"), (F.abs(t - 150000) > 50000).alias("far"), F.coalesce(F.nullif(s, F.lit("O")), F.lit("?")).alias("status"),
        F.regexp_replace(p, "[^A-Z]", "").alias("letters"), F.greatest("o_custkey", "o_orderkey").alias("larger"), F.when(F.col("o_orderkey") % 3 == 0, "fizz").otherwise("no").alias("fizz"),
    )


@registered("SELECT event_id, least(greatest(value, 10), 100) AS clipped FROM events")
def function_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function in Python over Arrow arrays."""
    return events(spark, sf_dir).select("event_id", vectors.clipped("value").alias("clipped"))


@registered("SELECT user_id, max(value) - min(value) AS spread FROM events GROUP BY user_id")
def function_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in Python over a group's values; without partial sums, so for groups that fit a task."""
    return events(spark, sf_dir).groupBy("user_id").agg(vectors.spread("value").alias("spread"))


@registered("SELECT item_id, generate_subscripts(w, 1)::INT - 1 AS place, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)")
def function_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function in Python, joined laterally."""
    return table(spark, sf_dir, "benchmark").lateralJoin(vectors.Words(F.col("text").outer())).select("item_id", "place", "word")


# Definitions


def definitions() -> dict[str, Callable[[], object]]:
    """Nodes, clusters, messages and processors, most of them with a fault that a check must find before anything runs."""

    @dataclass
    class Bare:
        n: int = 0

    @message_type("two")
    @dataclass
    class TwoKeys:
        @message_key("a")
        def a(self) -> str:
            return "a"

        @message_key
        def b(self) -> str:
            return "b"

    @mp
    class NoHandler:
        def clone(self):
            return self

    class Unmarked(samples.Counter):
        def clone(self):
            return self

    @mp
    class NoClone(samples.Counter): ...

    @mp
    class Wordy(samples.Counter):
        def clone(self):
            return self

        @passivation
        def leave(self, why: str) -> None: ...

    @mp
    class TakesBare:
        def clone(self):
            return self

        def take(self, message) -> None: ...

        take.__annotations__["message"] = Bare
        take = message_handler(take)

    whole = lambda: Node.builder("app").default_routing("managed").receiver()
    source = TableAdaptor("none", "event", "user_id", "event_id")
    return {
        "whole": lambda: whole().cluster("a").mp(samples.Counter()).cluster("b").adaptor(source).build(),
        "setting": lambda: whole().conf("router.managed.total_shards", "16").cluster("a").mp(samples.Counter()).build(),
        "unknown setting": lambda: whole().conf("router.none", 1),
        "shards no power of two": lambda: whole().conf("router.managed.total_shards", 12).cluster("a").mp(samples.Counter()).build(),
        "no cluster": lambda: whole().build(),
        "no name": lambda: Node.builder("").receiver().cluster("a").adaptor(source).build(),
        "name with a slash": lambda: Node.builder("a/b").receiver().cluster("a").adaptor(source).build(),
        "cluster with a colon": lambda: whole().cluster("a:b").mp(samples.Counter()).build(),
        "two clusters of a name": lambda: whole().cluster("a").mp(samples.Counter()).cluster("a").mp(samples.Evens()).build(),
        "empty cluster": lambda: whole().cluster("a").build(),
        "null cluster": lambda: Node("app", [None], "local", "managed").validate(),
        "processor and adaptor": lambda: whole().cluster("a").mp(samples.Counter()).adaptor(source).build(),
        "key source of an adaptor": lambda: whole().cluster("a").adaptor(source).key_source(lambda: ["x"]).build(),
        "no receiver": lambda: Node.builder("app").default_routing("managed").cluster("a").mp(samples.Counter()).build(),
        "adaptor without receiver": lambda: Node.builder("app").cluster("a").adaptor(source).build(),
        "no routing": lambda: Node.builder("app").receiver().cluster("a").mp(samples.Counter()).build(),
        "unknown router": lambda: whole().cluster("a").routing("nearest").mp(samples.Counter()).build(),
        "unknown container": lambda: whole().container("wooden").cluster("a").mp(samples.Counter()).build(),
        "container limit": lambda: whole().container("locking").cluster("a").mp(samples.Counter()).max_pending(5).build(),
        "limit without a queue": lambda: whole().cluster("a").mp(samples.Counter()).max_pending(5).build(),
        "builder before a cluster": lambda: whole().mp(samples.Counter()),
        "explicit destinations": lambda: Cluster("a", Processor.of(samples.Counter())).destinations("b"),
        "unmarked processor": lambda: Processor.of(Unmarked()),
        "processor without clone": lambda: Processor.of(NoClone()),
        "processor without handler": lambda: Processor.of(NoHandler()),
        "passivation with a parameter": lambda: Processor.of(Wordy()),
        "handler of no message": lambda: Processor.of(TakesBare()),
        "keys without discriminators": lambda: KeyExtractor().extract(TwoKeys()),
        "message without a key": lambda: TypedMessage(None, {}, ("event",)),
    }


GOOD = ("whole", "setting", "adaptor without receiver", "container limit")


@registered(f"SELECT * FROM (VALUES {', '.join(f"('{n}', {str(n in GOOD).lower()})" for n in definitions())}) AS v(definition, accepted)")
def checked_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of nodes, clusters, processors and messages accept; no table is read."""

    def accepted(make: Callable[[], object]) -> bool:
        try:
            make()
        except (TopologyError, ModelError, NotImplementedError):
            return False
        return True

    return spark.createDataFrame([(name, accepted(make)) for name, make in definitions().items()], "definition string, accepted boolean")

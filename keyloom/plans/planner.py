"""Topologies as running queries: what a node says about adaptors, schedules, eviction, key sources and bulk becomes a plan.

Over tables, execute() reads every adaptor and runs all clusters until no message is pending. Over streams, chained() makes one
query of clusters that follow one another, and Streams runs any topology, also one that feeds back, as a query for each cluster
with durable folders of messages between them. Settings of transports, threads and queues are Spark's own business and change
nothing here.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.plans.batch import RESULT, placed, run, sent
from keyloom.sources.adaptors import stream_sink
from keyloom.storage import remove
from keyloom.streaming.stateful import keyed, schedule
from keyloom.topology import Cluster, Node, Topology, TopologyError

MESSAGE = ("message_type", "key", "payload", "seq", "place")


def together(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise TopologyError("nothing gives messages: no adaptor, and no table of them")
    out = parts[0]
    for df in parts[1:]:
        out = out.union(df)
    return out


def read(spark: SparkSession, topology: Topology) -> list[DataFrame]:
    """What each adaptor gives, as messages."""
    return [placed(c.adaptor.read(spark)).select(*MESSAGE) for c in topology.clusters if c.adaptor is not None]


def execute(spark: SparkSession, *nodes: Node, messages: DataFrame | None = None, per_second: float = 1.0, rounds: int | None = None, states: dict[str, DataFrame] | None = None, kinds: Iterable[str] | None = None, fold: bool = False) -> dict[str, DataFrame]:
    """All clusters of the nodes over what their adaptors read, and over `messages`: {cluster: results}. See run()."""
    topology = Topology(*[n.validate() for n in nodes])
    given = [placed(messages).select(*MESSAGE)] if messages is not None else []
    return run(topology, together(read(spark, topology) + given), rounds, states, per_second, kinds, fold)


def _keys(spark: SparkSession, c: Cluster) -> DataFrame | None:
    return spark.createDataFrame([(str(k),) for k in c.key_source()], "key string") if c.key_source else None


def stage(spark: SparkSession, c: Cluster, messages: DataFrame) -> DataFrame:
    """A cluster's results over a stream, with its schedules in processing time."""
    if c.processor is None:
        raise TopologyError(f"{c.name} has no processor")
    return keyed(messages, c.processor, c.name, c.bulk, schedule(c.output_every) if c.processor.outputs else None, schedule(c.evict_every), keys=_keys(spark, c))


def chained(spark: SparkSession, node: Node, names: Sequence[str], messages: DataFrame | None = None) -> DataFrame:
    """The last cluster's results, with all of the named clusters as stages of one query, each fed by the one before it.

    The first one gets the adaptors' streams and `messages`. What a cluster sends to others than its follower is not kept.
    """
    topology = Topology(node.validate())
    flow = together(read(spark, topology) + ([placed(messages).select(*MESSAGE)] if messages is not None else []))
    results = None
    for name in names:
        results = stage(spark, topology[name], flow)
        flow = sent(results)
    return results


class Streams:
    """The clusters of nodes as one query each, over folders below `folder`, which all executors share.

    Every cluster reads what the adaptors and all clusters have written, itself among them, and takes the types it handles; so a
    topology may feed back. Messages and state outlive a restart with the same folder, and each message is handled once.
    """

    def __init__(self, spark: SparkSession, folder: str, *nodes: Node):
        self.spark, self.folder = spark, folder
        self.topology = Topology(*[n.validate() for n in nodes])
        self.names = [c.name for c in self.topology.clusters]
        files = spark._jvm.org.apache.hadoop.fs
        for name in self.names:
            at = files.Path(f"{folder}/{name}/results")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def _written(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(RESULT).parquet(f"{self.folder}/{name}/results").where("kind = 'message'").select(*MESSAGE)

    def plan(self, c: Cluster) -> DataFrame:
        if c.adaptor is not None:
            nulls = {"kind": F.lit("message"), "state": F.lit(None).cast("binary")}
            return placed(c.adaptor.read(self.spark)).withColumns(nulls).select(*[x.split()[0] for x in RESULT.split(", ")])
        flow = together([self._written(n) for n in self.names])
        return stage(self.spark, c, flow)

    def start(self, **trigger: Any) -> list:
        """All queries, running side by side; trigger: as for writeStream, every second by default."""
        return [self._start(c, trigger or {"processingTime": "1 second"}) for c in self.topology.clusters]

    def _start(self, c: Cluster, trigger: dict[str, Any]):
        at = f"{self.folder}/{c.name}"
        return stream_sink(self.plan(c), f"{at}/results", f"{at}/checkpoint", **trigger)

    def drain(self) -> int:
        """Run the queries over what is available, in turns, until none of them reads a message; how many turns that took."""
        turns = 0
        while True:
            turns, read_ = turns + 1, 0
            for c in self.topology.clusters:
                query = self._start(c, {"availableNow": True})
                query.awaitTermination()
                read_ += sum(p["numInputRows"] for p in query.recentProgress)
            if not read_:
                return turns

    def results(self, name: str) -> DataFrame:
        return self.spark.read.schema(RESULT).parquet(f"{self.folder}/{name}/results")

    def delete(self) -> None:
        """Remove all that the queries have written."""
        remove(self.spark, self.folder)

"""Counters of clusters and nodes as aggregates, and the balances that must hold between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Counter: kind of result row that it counts.
COUNTERS = {
    "dispatched": "dispatched", "processed": "processed", "failed": "failed", "created": "created", "deleted": "deleted", "evicted": "evicted",
    "unkeyed": "unkeyed", "unsent": "unsent", "output_failed": "output_failed", "sent": "message",
}


def cluster_counts(results: DataFrame, discarded: DataFrame | None = None) -> DataFrame:
    """One row of counters over a cluster's results. A failed activation counts as failed, but was never dispatched.

    discarded: rows that shedding marked, of which those marked so are counted. collisions are 0, as only one task has a key.
    """
    counts = results.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in COUNTERS.items()], F.lit(0).cast("long").alias("collisions"))
    if discarded is None:
        return counts.withColumn("discarded", F.lit(0).cast("long"))
    return counts.crossJoin(discarded.agg(F.count_if("discarded").alias("discarded")))  # one row each


def timers(results: DataFrame) -> DataFrame:
    """(timer, passes, ms): how many output passes and eviction checks ran, and how long they took in all."""
    own = results.where("kind = 'timing'").select(F.col("message_type").alias("timer"), F.from_json("payload", "passes long, ms double").alias("t"))
    return own.groupBy("timer").agg(F.sum("t.passes").alias("passes"), F.sum("t.ms").alias("ms"))


def balances(counts: DataFrame, received: int, discarded: int = 0) -> dict[str, bool]:
    """sent = dispatched + lost activations + discarded; dispatched = processed + failed handlers; live = created - deleted >= 0."""
    r = counts.first()
    lost = received - discarded - r["dispatched"]
    return {"received": lost >= 0 and lost <= r["failed"], "handled": r["dispatched"] == r["processed"] + r["failed"] - lost, "live": r["created"] >= r["deleted"]}


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with counters by type that fill as it runs, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("received"), F.count_if(F.col("key").isNull()).alias("without_key")), seen


def node_counts(delivered: DataFrame, cluster: str = "cluster", discarded: str | None = None) -> DataFrame:
    """One row for a node: messages received, those sent on to a cluster, those of types that nobody handles, and those shed.

    delivered: a message a row, with the clusters that receive it in an array column; discarded: a column of flags, if any.
    """
    n = F.coalesce(F.size(cluster), F.lit(0))
    gone = F.coalesce(F.col(discarded), F.lit(False)) if discarded else F.lit(False)
    return delivered.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(gone).alias("discarded"),
        F.coalesce(F.sum(F.when(~gone, n)), F.lit(0)).cast("long").alias("sent"), F.count_if(~gone & (n == 0)).alias("not_sent"),
    )


def progress(query) -> dict[str, int]:
    """A stream's node counters: rows received so far, and those that its state holds."""
    received = sum(p["numInputRows"] for p in query.recentProgress)
    last = query.lastProgress
    return {"received": received, "live": sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0}

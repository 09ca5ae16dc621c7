"""Output passes, eviction and passivation over bounded input, in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lives(df: DataFrame, key: str, ts: str, idle: int, *order: str) -> DataFrame:
    """df with `life`, from 0: a message more than `idle` seconds after the last one of its key finds a fresh instance."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    fresh = F.when(gap > idle * 1_000_000, 1).otherwise(0)
    return df.withColumn("fresh_", fresh).withColumn("life", F.sum("fresh_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("fresh_")


def evicted(df: DataFrame, key: str, ts: str, idle: int, *aggs: Column) -> DataFrame:
    """A row for each instance that lived: its first and last message and its state at the end."""
    found = lives(df, key, ts, idle)
    return found.groupBy(key, "life").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("messages"), *aggs)


def passivations(df: DataFrame, key: str, ts: str, idle: int) -> DataFrame:
    """Instances and whether an eviction check at the end of the input has passivated them."""
    found = evicted(df, key, ts, idle)
    end = df.agg(F.max(ts).alias("end_"))
    late = F.unix_micros(F.col("end_").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) > idle * 1_000_000
    last = F.col("life") == F.max("life").over(Window.partitionBy(key))
    return found.crossJoin(F.broadcast(end)).select(key, "life", "first_seen", "last_seen", "messages", (~last | late).alias("passivated"))  # end is one row


def output_pass(df: DataFrame, key: str, ts: str, every: str = "day") -> DataFrame:
    """What every live instance puts out at the end of each period: its count so far, also in periods without a message.

    Each key's periods run from its first message to the end of all input.
    """
    period = F.date_trunc(every, F.col(ts))
    counts = df.groupBy(key, period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    end = F.broadcast(df.agg(F.max(period).alias("end_")))  # one row
    grid = counts.groupBy(key).agg(F.min("period").alias("begin_")).crossJoin(end)
    grid = grid.select(key, F.explode(F.sequence("begin_", "end_", F.expr(f"interval 1 {every}"))).alias("period"))
    w = Window.partitionBy(key).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(counts, [key, "period"], "left").select(key, "period", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("total"))


def preinstantiated(keys: DataFrame, state: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """An instance for every key of a source of keys, those without a message in their first state."""
    return keys.join(state, key, "left").fillna(defaults)

"""State per key as expressions: counts, last and largest values, global tables, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.batch import Declarative


def running_count(df: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """What the n-th message of a key emits: n - 1."""
    return Declarative({"running_count": F.count(F.lit(1))}, before=True).lower(df, key, seq)


def final_count(df: DataFrame, key: str) -> DataFrame:
    """The last count that each key emitted."""
    return Declarative({"last_count": F.count(F.lit(1)) - 1}, emit="final").lower(df, key, [])


def last_value(df: DataFrame, key: str, value: str, seq: str | Column) -> DataFrame:
    """The value that arrived last for each key, which need not be the largest."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias("last_value"))


def keep_max(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias("max_value"))


def first_message(df: DataFrame, key: str, seq: str | Column, *columns: str) -> DataFrame:
    """What activates each instance: the first message of its key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), seq).alias("m")).select(key, "m.*")


def global_table(df: DataFrame, *aggs: Column) -> DataFrame:
    """State that all instances of a cluster share: an aggregate without keys; partial sums make it one small exchange."""
    return df.agg(*aggs)


def top_k(df: DataFrame, key: str, rank: str, k: int = 10) -> DataFrame:
    """The k keys with the largest rank, one entry for each, equal ranks by key. Exact, whatever the order of arrival."""
    best = df.groupBy(key).agg(F.max(rank).alias(rank))
    return best.orderBy(F.desc(rank), key).limit(k)


def sorted_pairs(df: DataFrame, key: str, rank: str) -> DataFrame:
    return df.orderBy(F.desc(rank), key)


def cogroup(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Messages of several types that share one state per key: one stream of them, tagged by type."""
    out = None
    for name, df in tables.items():
        own = df.withColumn("message_type", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def failing(df: DataFrame, wrong: Column, aggs: Sequence[Column], key: str) -> DataFrame:
    """State and counters of a handler that fails on some messages: their changes stay, their results are dropped."""
    flag = F.coalesce(wrong, F.lit(False))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("dispatched"), F.count_if(flag).alias("failed"), F.count_if(~flag).alias("processed"), *aggs)

"""Messages to the clusters that handle their types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.topology import Topology


def is_handled(types: Iterable[str], column: str = "message_type") -> Column:
    """Whether anybody handles a row's type; nobody handles a null one."""
    return F.coalesce(F.col(column).isin(*types), F.lit(False))


def handled(df: DataFrame, types: Iterable[str], column: str = "message_type") -> DataFrame:
    return df.where(is_handled(types, column))


def not_sent(df: DataFrame, types: Iterable[str], column: str = "message_type") -> DataFrame:
    """Messages of types that nobody handles, null ones among them."""
    return df.where(~is_handled(types, column))


def receiving(df: DataFrame, receivers: dict[str, list[str]], types: Column) -> DataFrame:
    """df with `cluster`, the clusters that handle a message's types; one that handles two of them is there twice.

    The receivers of a type are a constant of the plan, so this is a projection, without a join.
    """
    table = F.create_map(*[x for t, cs in receivers.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cs]))])
    return df.withColumn("cluster", F.flatten(F.transform(types, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def deliveries(df: DataFrame, receivers: dict[str, list[str]], types: str = "message_types") -> DataFrame:
    """A row for each cluster that handles each of a message's types; two types of one cluster make two deliveries."""
    return receiving(df, receivers, F.col(types)).withColumn("cluster", F.explode("cluster"))


def branches(df: DataFrame, topology: Topology, column: str = "message_type") -> dict[str, DataFrame]:
    """What each cluster gets; branches of types that nobody handles aren't built."""
    return {c.name: handled(df, sorted(c.handled()), column) for c in topology.clusters if c.handled()}


def grouped(df: DataFrame, key: str) -> DataFrame:
    """Deal once by key, so that keyed stages of a group need no exchange of their own."""
    return df.repartition(F.col(key))

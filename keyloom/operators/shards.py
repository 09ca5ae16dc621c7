"""Shards of the key space: who owns how many, and what moves when nodes come and go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.hashing import SHARDS, check_shards, shard_of


def quota(shards: int, nodes: int, least: int = 1) -> list[int]:
    """Shards of each live node: an even share of the nodes there should be, one more for the first ones."""
    check_shards(shards)
    n = max(nodes, least)
    return [shards // n + (rank < shards % n) for rank in range(nodes)]


def allocate(shards: int, nodes: Sequence[str], owned: dict[str, Sequence[int]] | None = None, least: int = 1) -> dict[str, list[int]]:
    """An assignment that keeps as many shards where they are as the quotas allow; free ones go out in order."""
    owned = owned or {}
    most = dict(zip(nodes, quota(shards, len(nodes), least)))
    taken: set[int] = set()
    out: dict[str, list[int]] = {}
    for n in nodes:
        keep = [s for s in owned.get(n, ()) if 0 <= s < shards and s not in taken][: most[n]]
        taken.update(keep)
        out[n] = keep
    free = iter(s for s in range(shards) if s not in taken)
    for n in nodes:
        while len(out[n]) < most[n] and (s := next(free, None)) is not None:
            out[n].append(s)
    return {n: sorted(own) for n, own in out.items()}


def quotas(df_source: DataFrame, shards: int, least: int = 1) -> DataFrame:
    """(nodes, rank, shards) for each number of live nodes in the column `nodes`."""
    n = F.greatest(F.col("nodes"), F.lit(least))
    grid = df_source.select("nodes", F.explode(F.expr("sequence(0L, nodes - 1)")).alias("rank"))
    return grid.select("nodes", "rank", (F.floor(F.lit(shards) / n) + F.when(F.col("rank") < F.lit(shards) % n, 1).otherwise(0)).cast("long").alias("shards"))


def with_shard(df: DataFrame, key: str, text: bool = False, shards: int = SHARDS) -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(key), text, shards))


def routed(df: DataFrame, assignment: dict[str, Sequence[int]], key: str, text: bool = False, shards: int = SHARDS) -> DataFrame:
    """df with `node`, null where a shard has no owner: such messages aren't sent. The table of shards is a constant."""
    owner: list[str | None] = [None] * check_shards(shards)
    for n, own in assignment.items():
        for s in own:
            owner[s] = n
    table = F.array(*[F.lit(o).cast("string") for o in owner])
    return with_shard(df, key, text, shards).withColumn("node", F.get(table, F.col("shard").cast("int")))


def evicted_by_shrink(df: DataFrame, key: str, before: Sequence[int], after: Sequence[int], text: bool = False, shards: int = SHARDS) -> DataFrame:
    """Keys whose instances a node passivates when it keeps only the shards `after` of those `before`."""
    gone = sorted(set(before) - set(after))
    return with_shard(df.select(key).distinct(), key, text, shards).where(F.col("shard").isin(*gone) if gone else F.lit(False))

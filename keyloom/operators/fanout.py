"""One row of input as the keyed messages it stands for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """A message for each type id."""
    return df.select("*", F.explode(F.array(*[F.lit(t) for t in types])).alias("message_type"))


def by_keys(df: DataFrame, base: str, keys: Mapping[str, Column]) -> DataFrame:
    """A message for each discriminated key, of type base(discriminator); null keys can't be sent and are left out."""
    each = [F.struct(F.lit(f"{base}({d})").alias("message_type"), k.cast("string").alias("message_key")) for d, k in keys.items()]
    return df.select("*", F.explode(F.array(*each)).alias("m")).select(*df.columns, "m.message_type", "m.message_key").where("message_key IS NOT NULL")


def with_supertypes(df: DataFrame, type_column: str, parents: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each message under its own type and under those above it."""
    own = F.col(type_column)
    up = F.array().cast("array<string>")
    for child, above in parents.items():
        up = F.when(own == child, F.array(*[F.lit(a) for a in above])).otherwise(up)
    return df.select("*", F.explode(F.concat(F.array(own), up)).alias("message_type"))


def unwound(df: DataFrame, column: str, depth: int = 1) -> DataFrame:
    """A handler's results as single messages: nested arrays of `depth`, flattened; null and empty ones give none."""
    nested = F.col(column)
    for _ in range(depth - 1):
        nested = F.flatten(F.transform(nested, lambda x: F.coalesce(x, F.array())))
    return df.select(*[c for c in df.columns if c != column], F.explode(nested).alias(column)).where(F.col(column).isNotNull())


def has_key(key: str) -> Column:
    """Whether a row has a key and so can be sent."""
    return F.col(key).isNotNull()


def keyed_only(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(messages, rows without a key, which are counted and dropped)."""
    return df.where(has_key(key)), df.where(~has_key(key))

"""Exact hashes of keys and the shards they fall to, as column expressions.

A shard is (514229 * hash) & (shards - 1), with the hash of a JVM Integer, Long or String. Only the low bits of the product
survive the mask, so 32-bit overflow can be left out and a text's hash may be folded modulo the number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the shard function.
FACTOR = 514229
SHARDS = 256


def check_shards(shards: int) -> int:
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    return shards


def long_hash(key: Column) -> Column:
    """Low 32 bits of a long folded onto its high ones, as an unsigned number; the same for an int from 0."""
    return key.bitwiseXOR(F.shiftrightunsigned(key.cast("long"), 32)).bitwiseAND(F.lit((1 << 32) - 1))


def string_hash(text: Column, modulo: int = 1 << 32) -> Column:
    """A string's polynomial hash in 31, modulo a power of two, over its UTF-16 units in the basic plane."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % modulo)


def shard_of(key: Column, text: bool = False, shards: int = SHARDS) -> Column:
    check_shards(shards)
    own = string_hash(key, shards) if text else long_hash(key.cast("long")) % shards
    return (own * (FACTOR % shards)).bitwiseAND(F.lit(shards - 1).cast("long"))

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions.hashing import check_shards, shard_of
from keyloom.operators.shards import allocate, evicted_by_shrink, quota, routed


def java(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h


def test_shards_of_longs_and_texts(spark):
    longs = [0, 1, 149, 2**31, 2**40 + 5, -1, -7]
    df = spark.createDataFrame([(x,) for x in longs], "k long")
    got = {r["k"]: r["s"] for r in df.select("k", shard_of(F.col("k")).alias("s")).collect()}
    assert got == {x: (514229 * ((x ^ ((x & (1 << 64) - 1) >> 32)) & 0xFFFFFFFF)) & 255 for x in longs}
    texts = ["", "a", "click", "a longer key with ümlaut"]
    df = spark.createDataFrame([(x,) for x in texts], "k string")
    got = {r["k"]: r["s"] for r in df.select("k", shard_of(F.col("k"), text=True).alias("s")).collect()}
    assert got == {x: (514229 * java(x)) & 255 for x in texts}


def test_a_number_of_shards_is_a_power_of_two():
    for wrong in (0, 3, 100, -4):
        with pytest.raises(ValueError):
            check_shards(wrong)


@given(st.integers(0, 8), st.integers(1, 12), st.integers(1, 12))
def test_quotas(power, nodes, least):
    own = quota(1 << power, nodes, least)
    assert max(own) - min(own) <= 1 and sum(own) <= 1 << power
    assert sum(own) == 1 << power or least > nodes


@given(st.integers(1, 6), st.integers(1, 6))
def test_rebalancing_moves_little(before, after):
    old = allocate(64, [f"n{k}" for k in range(before)])
    new = allocate(64, [f"n{k}" for k in range(after)], old)
    assert sorted(s for own in new.values() for s in own) == list(range(64))
    most = quota(64, after)
    for k in range(min(before, after)):
        assert len(set(new[f"n{k}"]) & set(old[f"n{k}"])) == min(len(old[f"n{k}"]), most[k])


def test_messages_of_shards_without_an_owner(spark):
    df = spark.range(100).toDF("k")
    got = routed(df, {"a": range(8)}, "k", shards=16)
    assert {r["node"] for r in got.where("shard < 8").collect()} == {"a"}
    assert {r["node"] for r in got.where("shard >= 8").collect()} == {None}
    assert evicted_by_shrink(df, "k", range(8), range(8), shards=16).count() == 0

import glob

import duckdb
import pytest

from keyloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(value, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(value, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_scans_prune_and_push_down(spark):
    plan = catalogue.relational_aggregate(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_one_exchange_serves_a_group(spark):
    plan = catalogue.group_colocation(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing as M


def test_matches_sql(documents, texts):
    con = duckdb.connect()
    frame = documents.select("doc_id", "text", "lang", "source").where("doc_id IS NOT NULL").toPandas()
    con.register("documents", frame)
    want = sorted(con.execute(f"SELECT doc_id, topic, n_tokens, probability, kept FROM ({M.sql()})").fetchall())
    got = sorted(tuple(r) for r in M.mixture(documents.where("doc_id IS NOT NULL")).select("doc_id", "topic", "n_tokens", "probability", "kept").collect())
    assert got == want
    assert M.mixture(documents).count() == len(texts)


def test_marginals_reach_their_targets(spark):
    draw = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(draw.integers(1, 90))), ["en", "fr"][int(draw.random() < 0.3)], f"s{int(draw.integers(0, 5)) if draw.random() > 0.4 else 0}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {"source": {f"s{k}": 1.0 for k in range(5)}, "lang": {"en": 0.5, "fr": 0.5}}
    got = M.weighted(df, given).withColumn("w", F.col("mix_tokens") * F.col("mix_probability"))
    for column, n in (("mix_source", 5), ("mix_lang", 2)):
        shares = [r["s"] for r in got.groupBy(column).agg(F.sum("w").alias("s")).collect()]
        assert np.allclose(np.array(shares) / sum(shares), 1 / n, atol=1e-3)
    most = got.agg(F.max("mix_probability")).first()[0]
    assert most == pytest.approx(1.0)
    kept = M.sample(df, given)
    share = kept.agg(F.sum(M.tokens(F.col("text")))).first()[0] / got.agg(F.sum("w")).first()[0]
    assert 0.85 < share < 1.15 and kept.columns == df.columns


def test_a_level_without_weight_is_never_drawn(spark):
    df = spark.createDataFrame([(k, "a b c", "en", f"s{k % 2}") for k in range(50)], "doc_id long, text string, lang string, source string")
    assert {r["source"] for r in M.sample(df, {"source": {"s1": 1.0}}).collect()} == {"s1"}


def test_many_sources_join_by_a_shuffle(documents, monkeypatch):
    before = sorted(map(str, M.mixture(documents).collect()))
    monkeypatch.setattr(M, "BROADCAST", 1)
    assert sorted(map(str, M.mixture(documents).collect())) == before


def test_any_number_of_languages(spark, documents, monkeypatch):
    """More levels than the driver keeps: the same probabilities, from tables alone."""
    found = lambda: sorted((str(r["doc_id"]), round(r["mix_probability"], 9)) for r in M.weighted(documents, rounds=2).collect())
    before = found()
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", 3)
    assert found() == before


def test_targets_that_do_not_go_together_are_said(spark):
    df = spark.createDataFrame([(k, "a b c", "en" if k % 2 else "fr", f"s{k % 2}") for k in range(50)], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="misses its target"):
        M.mixture(df, {"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.9, "fr": 0.1}}).collect()


def test_empty_tables_and_texts(spark, documents, no_documents):
    assert M.mixture(no_documents).collect() == [] and M.sample(no_documents).collect() == []
    blank = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [r["probability"] for r in M.mixture(blank).collect()] == [0.0, 0.0]
    assert M.sample(documents).columns == documents.columns

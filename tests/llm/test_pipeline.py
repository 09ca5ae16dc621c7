import glob

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from keyloom.llm import licences, mixing, pii, registry, secrets, spans, toxicity
from keyloom.llm.common import BATCH_BYTES
from keyloom.llm.packing import packed
from keyloom.storage import cut

from .test_packing import check_layout, want
from .test_simhash import closed, shingles
from .test_spans import brute_spans, planted
from .test_toxicity import scalar_score

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[2] > sizes[4] > 0
    direct = sorted(map(str, docs.drop("sequence_id", "offset").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) == direct


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.columns == packed(spark.read.parquet(f"{DATA}/documents.parquet")).columns and docs.count() == 0


def test_odd_rows_pass_all_stages(spark, documents, texts):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == documents.columns
    assert 0 < docs.count() < len(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()


@pytest.mark.parametrize("name", ["toxicity", "simhash_near_dedup", "packing"])
def test_workers_get_little_text_at_once(spark, no_documents, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, no_documents, DATA)

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    wide = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    assert wide.mapInArrow(sizes, "n long").first()[0] < 1.1 * BATCH_BYTES


def masked(text, listed):
    """A text with its spans, kind:start:end, replaced one after the other, those that overlap as one under the first one's kind."""
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in listed.split(",") if x))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"<{kind}>"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def test_all_stages_in_turn_match_brute_force(spark, documents, texts, tmp_path):
    own = [(i, t) for i, t in texts if i is not None] + [(1000 + i, t) for i, t in planted(60, 4)[0]]
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 4}" if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(own)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, k % 4 == 0) for k, (i, _) in enumerate(own)], "doc_id long, toxic boolean").selectExpr("doc_id", "int(toxic) AS toxic")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    clean = [r for r in rows if scalar_score(model, (r[1] or "").encode()) < 0.5 or len(r[1] or "") > 20_000 and model.scores([r[1].encode()])[0] < 0.5]
    assert 0 < len(clean) < len(rows)
    sets = [set(shingles(r[1], 5)) for r in clean]
    linked = [(a, b) for a in range(len(clean)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = {}
    for k, root in enumerate(closed(len(clean), linked)):
        groups.setdefault(root, []).append(clean[k])
    single = [min(g, key=lambda r: r[0]) for g in groups.values()]
    found = brute_spans([r[:2] for r in single])
    safe = [(i, masked(t, found[i]) if t is not None else None, lang, source) for i, t, lang, source, _ in single]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(safe, columns=["doc_id", "text", "lang", "source"]))
    drawn = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({mixing.sql()})").fetchall() if kept}
    assert 0 < len(drawn) < len(safe)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want([r[:2] for r in safe if r[0] in drawn])
    assert check_layout(got) <= -(-sum(r["length"] for r in got) // 2048) + 2


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith(("op7", "op8", "op10"))))
def test_native_operators_run_no_python(spark, name, monkeypatch):
    """Neither what is written on the way nor the result has a step in Python."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df)

    for module in (spans, secrets, pii, licences):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", seen)
    plans.append(registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString())
    assert len(plans) >= 3 and "parquet" in plans[0]
    assert not any(x in plan for plan in plans for x in ("Python", "Pandas", "ArrowEval", "MapInArrow", "LocalTableScan"))


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and glob.glob(DATA)

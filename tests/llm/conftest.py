import random

import pytest

LONG = " ".join(f"word{k} and more" for k in range(30_000))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, near copies, a long text, marks of all sorts."""
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(2, 9))) for _ in range(400)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 300)))))
    base = rows[7][1] + " " + rows[8][1] + " " + rows[9][1]
    rows += [(100 + k, " ".join(w if draw.random() > 0.01 else draw.choice(vocabulary) for w in base.split())) for k in range(12)]
    rows += [(200, base), (201, base), (201, base), (202, base.upper()), (203, base + " é Ünïcode 漢字 😀   end")]
    rows += [(300, None), (301, ""), (302, "  \t\n "), (303, "one"), (304, "one two"), (None, "no id here"), (None, None), (305, "aaaa" * 2000), (306, LONG)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, kind string, spans string, core string, mix_source string, pipeline_row long"


@pytest.fixture(scope="session")
def documents(spark, texts, tmp_path_factory):
    """The texts as documents, with columns of names that operators use inside."""
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 4}" if k % 7 else None, len(t or ""), k, -k, "kind", None, "", "m", k) for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

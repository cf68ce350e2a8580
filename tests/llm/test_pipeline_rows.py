"""Stages of the pipeline on odd rows: null and repeated ids, ties, empty and long texts, extra columns with names that the stages use."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

TABLES = "/root/testdata/sf0.001"
EXTRA = ["toxicity", "toxic_spans", "row_key", "row_place", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "__id", "__doc", "n", "node"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(100_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    one, two = prose(1, 300), prose(2, 300)
    near = one.split(" ")
    near[100] = "changed"
    item = spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    rows = [(5, one), (3, " ".join(near)), (None, one), (7, two), (7, prose(3, 300)), (8, prose(4, 200)), (8, None), (9, None), (9, None), (10, ""), (11, "x"), (None, None), (12, prose(5, 60_000)), (13, prose(6, 50) + " " + item + " " + prose(7, 50)), (None, prose(8, 50) + " " + item)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(d, t, "aa", "s", len(t) if t is not None else None, *(f"own {c}" for c in EXTRA)) for d, t in rows], schema).repartition(3).persist()


@pytest.mark.parametrize("k", range(4))
def test_columns_stay(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, TABLES)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in EXTRA)
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), TABLES).count() == 0


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, len(r.text or "")) for r in df.collect())


def test_near_copies_by_row(spark, docs):
    out = corpus_pipeline.without_near_copies(spark, docs, TABLES)
    left = ids(out)
    assert [i for i, n in left if i in (3, 5)] == [3]  # the smallest id of the group; its copy without an id goes too
    assert sum(i == 7 for i, _ in left) == 2 and sum(i == 8 for i, _ in left) == 2  # different texts of one id
    assert sum(i == 9 for i, _ in left) == 1  # equal rows
    assert {10, 11, 12, 13} <= {i for i, _ in left}
    assert [n > 0 for i, n in left if i == -1] == [False, True]  # a null text stays, and the text that has no copy


def test_benchmark_by_row(spark, docs):
    before, after = ids(docs), ids(corpus_pipeline.without_benchmark(spark, docs, TABLES))
    gone = list(before)
    for r in after:
        gone.remove(r)
    assert len(gone) == 2 and {i for i, _ in gone} == {13, -1}


def test_repeated_passages_of_odd_rows(spark, docs):
    out = corpus_pipeline.without_repeated_passages(spark, docs, TABLES)
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in out.collect())
    assert sum(r.text is None for r in out.collect()) == 4


def test_tokens_of_odd_rows(spark, docs):
    out = corpus_pipeline.tokenized(spark, docs, TABLES)
    assert out.count() == docs.count() and out.filter("text is null" if "text" in out.columns else "n_tokens = 0").count() == 5

import os

import pytest
from compare import DATA, assert_same

import corpus_pipeline
from strandline.llm import queries as llm


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, duck, name):
    df = llm.queries()[name](spark, DATA)
    sql = llm.oracle_sql().get(name)
    if sql:
        assert_same(df, duck, sql)
    else:
        assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision."""
    from fixtures import covered_words
    from test_near_dedup import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = spark.createDataFrame(corpus_pipeline.quality(spark, docs, DATA).collect(), docs.schema)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and 0 < len(rows) < docs.count()
    near = corpus_pipeline.near_duplicates(spark, kept, DATA).collect()
    comp = brute(rows, 5)
    assert {r.doc_id for r in near} == {i for i, c in comp.items() if i == c}
    near_rows = [tuple(r) for r in near]
    cut = {r.doc_id: r for r in corpus_pipeline.substrings(spark, spark.createDataFrame(near_rows, docs.schema), DATA).collect()}
    for r, (_, _, k) in zip(near_rows, covered_words(near_rows, 35), strict=True):
        assert cut[r[0]].text == k.decode() and cut[r[0]].n_chars == len(k.decode()) and cut[r[0]].lang == r[2]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and out.columns[0] == "doc_id"
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *llm.queries()} <= set(entry.queries())
    assert os.path.exists(os.path.join(entry.HERE, "corpus_pipeline.py"))

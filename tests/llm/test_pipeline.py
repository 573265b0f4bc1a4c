"""The corpus pipeline: its stages, what they keep, and the registration of all queries."""

import __spark_entry__
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], SF).cache())
    return out


def test_stages_keep_the_columns_and_narrow(stages):
    for x in stages[1:4]:
        assert x.columns == stages[0].columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in stages[:4]]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] and ids[3]
    assert {r.doc_id for r in stages[4].collect()} == ids[3]


def test_run_equals_its_stages(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (corpus_pipeline.run(spark, SF), stages[4]))
    assert a == b


def test_stages_on_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_bloom_cascade", "op6_merkle_fixity"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(str, got.fillna("").values.tolist())) == sorted(map(str, want.fillna("").values.tolist()))

"""Late fetch of stored fields, and commits that report what they wrote."""

import uuid

from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources.files import append_commits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_hits_send_a_runtime_filter(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    spark.range(3000).select((F.col("id") * 7 % 5000).alias("doc_id"), F.lit(1).alias("query_id")).write.parquet(
        f"{tmp_path}/hits")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hits = spark.read.parquet(f"{tmp_path}/hits").filter("doc_id % 5 < 2")
        got = search.fetch(hits, spark.read.parquet(f"{tmp_path}/docs"), ["text"])
        assert "might_contain" in plan(got)
        rows = got.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 1200 and all(r.text == f"text {r.doc_id}" for r in rows)


def test_stored_fields_need_no_shuffle(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("twice"))
    name = f"fields_{uuid.uuid4().hex}"
    stored = search.store_fields(docs, name, f"{tmp_path}/fields", buckets=4)
    try:
        a = stored.select("doc_id", "twice").hint("merge")
        got = search.fetch(a.select("doc_id", F.lit(1).alias("query_id")), stored, ["twice"])
        assert "Exchange hashpartitioning" not in plan(got)
        assert got.filter("twice = 2 * doc_id").count() == 1000
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_commits_count_and_time(spark, tmp_path):
    docs = spark.range(100).select("id", (F.col("id") % 3).alias("batch_id"))
    got = {r.batch_id: r for r in append_commits(docs, f"{tmp_path}/i").collect()}
    assert {k: r.n_docs for k, r in got.items()} == {0: 34, 1: 33, 2: 33} and all(r.seconds > 0 for r in got.values())
    again = append_commits(docs.filter("batch_id = 1"), f"{tmp_path}/i").collect()
    assert again[0].n_docs == 33 and spark.read.parquet(f"{tmp_path}/i").count() == 100

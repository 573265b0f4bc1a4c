"""Count windows on the arbitrary-state API against their batch form, and idle shards."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.streaming import windows as W

SCHEMA = "k long, shard string, id string, text string"


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k) for k in W.STATE_STORE}
    for k, v in W.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def feed(spark, root, drops, **kw):
    """Runs the drops as one micro-batch each and returns what came out and the rows held after each."""
    held = []
    for i, rows in enumerate(drops):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in/{i}")
        src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        q = (W.count_windows_state(src, 5, "k", "id", "text", "shard", **kw).writeStream.format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        state = (spark.read.format("statestore").option("path", f"{root}/progress").option("stateVarName", "open").load())
        held.append(state.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
    return spark.read.schema(W.OUT).parquet(f"{root}/out"), held


def test_equals_batch_windows(spark, store, tmp_path):
    rows = [(i, "ab"[i % 3 % 2], f"m{i}", f"t{i}") for i in range(53)]
    drops = [rows[:7], rows[7:8], rows[8:40], rows[40:]]
    out, held = feed(spark, str(tmp_path), drops)
    want = W.count_windows(spark.createDataFrame(rows, SCHEMA), 5, ["k"], shard_col="shard").select(
        "shard", "window_id", "pos", "id", "text")
    assert sorted(out.collect()) == sorted(want.collect())
    assert max(held) <= 4


def test_idle_shard_hands_back(spark, store, tmp_path):
    rows = [(i, "idle", f"x{i}", "t") for i in range(7)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = (W.count_windows_state(src, 5, "k", "id", "text", "shard", idle_ms=2000).writeStream.format("memory")
         .queryName("idle_shards").option("checkpointLocation", f"{tmp_path}/progress")
         .trigger(processingTime="500 milliseconds").start())
    try:
        out, until = spark.table("idle_shards"), time.time() + 60
        while out.count() < 7 and time.time() < until:
            time.sleep(0.5)
        rows = out.collect()
    finally:
        q.stop()
    back = [r for r in rows if r.window_id == W.HANDED_BACK]
    assert sorted(r.id for r in back) == ["x5", "x6"] and len(rows) == 7
    again = W.reshard(spark.createDataFrame(back, W.OUT), 2).collect()
    assert sorted(r.id for r in again) == ["x5", "x6"] and {r.shard for r in again} <= {"0", "1"}

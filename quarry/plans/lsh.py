"""Min-hash sketches and LSH search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import lsh as L
from quarry.plans import register
from quarry.plans.common import sql_std_tokens, tbl
from quarry.plans.textual import SQL_FEATURE_TOKENS, feature_string

B = L.DEFAULT_BUCKETS
H32 = "('0x' || substr(md5(s), 1, 8))::BIGINT"


def sql_sketch(sh_cte: str) -> str:
    """CTEs turning ``sh(id, s)`` into ``rot(id, bucket, hash)`` with rotation."""
    return f"""
mins AS (SELECT id, {H32} % {B} AS bucket, min({H32}) AS h FROM {sh_cte} GROUP BY id, {H32} % {B}),
grid AS (SELECT id, unnest(range({B})) AS bucket FROM (SELECT DISTINCT id FROM mins)),
filled AS (SELECT g.id, g.bucket, m.h FROM grid g LEFT JOIN mins m USING (id, bucket)),
rot AS (SELECT id, bucket, coalesce(
          first_value(h IGNORE NULLS) OVER (PARTITION BY id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
          first_value(h IGNORE NULLS) OVER (PARTITION BY id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hash
        FROM filled)"""


def sql_shingles3(table: str, idc: str, alias: str) -> str:
    return f"""{alias} AS (SELECT id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1),
      lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END) AS s
   FROM (SELECT {idc} AS id, {sql_std_tokens('text')} AS t FROM {table}))"""


def _doc_shingles(spark, sf_dir, table="documents", idc="doc_id", n=3):
    d = tbl(spark, sf_dir, table).select(F.col(idc).alias("id"), TX.standard_tokens(F.col("text")).alias("t"))
    return d.select("id", TX.shingles(F.col("t"), n, n).alias("sh"))


def _sketch_out(sk):
    return sk.select(F.col("id"), F.col("n_filled").cast("long"),
                     F.array_join(F.col("sketch").cast("array<string>"), ",").alias("sketch"))


SQL_EMB_SHINGLES = f"""
ft AS (SELECT vec_id AS id, list_transform(list_transform({SQL_FEATURE_TOKENS}, lambda x: substr(x, 1, 3)),
         lambda x, i: i || '_' || x) AS t FROM embeddings),
sh AS (SELECT id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3),
         lambda i: array_to_string(t[i:i + 4], ' ')) ELSE [] END) AS s FROM ft)"""


@register("lsh_sketch", f"""WITH {SQL_EMB_SHINGLES}, {sql_sketch('sh')}
SELECT id, (SELECT count(*) FROM mins WHERE mins.id = rot.id)::BIGINT AS n_filled, string_agg(hash::VARCHAR, ',' ORDER BY bucket) AS sketch
FROM rot GROUP BY id""")
def lsh_sketch(spark, sf_dir):
    """L1 (+L2): embedding → feature string → tokens (A8) → truncated to 3
    → position-tagged (A10) → 5-shingles (A11) → 512-bucket min-hash with rotation (A12)."""
    e = tbl(spark, sf_dir, "embeddings")
    toks = TX.position_tokens(TX.truncate_tokens(TX.feature_tokens(feature_string()), 3))
    f = e.select(F.col("vec_id").alias("id"), toks.alias("t")).select("id", TX.shingles(F.col("t"), 5, 5).alias("sh"))
    return _sketch_out(L.sketch(f, "id", "sh"))


@register("minhash_sketch", f"""WITH sh AS (SELECT doc_id AS id, unnest({sql_std_tokens('text')}) AS s FROM documents),
{sql_sketch('sh')}
SELECT id, (SELECT count(*) FROM mins WHERE mins.id = rot.id)::BIGINT AS n_filled, string_agg(hash::VARCHAR, ',' ORDER BY bucket) AS sketch
FROM rot GROUP BY id""")
def minhash_sketch(spark, sf_dir):
    """Min-hash sketch (512 buckets, rotation) of every document's tokens."""
    d = tbl(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), TX.standard_tokens(F.col("text")).alias("t"))
    return _sketch_out(L.sketch(d, "id", "t"))


def _sql_two_sketches():
    return (f"{sql_shingles3('documents', 'doc_id', 'dsh')}, {sql_shingles3('benchmark', 'item_id', 'qsh')},"
            + sql_sketch("dsh").replace("mins", "dmins").replace("grid", "dgrid").replace("filled", "dfilled")
            .replace("rot AS", "drot AS") + ","
            + sql_sketch("qsh").replace("mins", "qmins").replace("grid", "qgrid").replace("filled", "qfilled")
            .replace("rot AS", "qrot AS"))


@register("lsh_search", f"""WITH {_sql_two_sketches()},
m AS (SELECT q.id AS query_id, d.id AS doc_id, count(*)::DOUBLE AS score FROM qrot q JOIN drot d USING (bucket, hash)
      GROUP BY q.id, d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def lsh_search(spark, sf_dir):
    """L3 (+Q5): documents sharing min-hash tokens (word 3-shingles, no
    position tags) with each benchmark passage; score = shared tokens; top-10."""
    dsk = L.sketch(_doc_shingles(spark, sf_dir), "id", "sh")
    qsk = L.sketch(_doc_shingles(spark, sf_dir, "benchmark", "item_id"), "id", "sh")
    r = L.lsh_search(L.sketch_long(dsk, "id"), L.sketch_long(qsk, "id").withColumnRenamed("id", "query_id"), "id")
    return r.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@register("lsh_band_size", f"""
WITH n AS (SELECT item_id, count(DISTINCT s)::BIGINT AS num_hash FROM (
  SELECT item_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END) AS s
  FROM (SELECT item_id, {sql_std_tokens('text')} AS t FROM benchmark)) GROUP BY item_id)
SELECT item_id, num_hash,
  coalesce(num_hash // list_filter(range(1, num_hash + 1), lambda b: 1 - pow(1 - pow(0.5, num_hash // b), b) > 0.9)[1], 1)::BIGINT AS rows_etp90,
  coalesce(num_hash // list_filter(range(1, num_hash + 1), lambda b: 1 - pow(1 - pow(0.8, num_hash // b), b) > 0.5)[1], 1)::BIGINT AS rows_etp50
FROM n""")
def lsh_band_size(spark, sf_dir):
    """L4: rows per band for every benchmark passage with num_hash = its distinct
    3-shingles, at (similarity 0.5, target 0.9) and (0.8, 0.5)."""
    sh = _doc_shingles(spark, sf_dir, "benchmark", "item_id")
    n = sh.select(F.col("id").alias("item_id"), F.size(F.array_distinct("sh")).cast("long").alias("num_hash")).filter(
        F.col("num_hash") > 0)
    return n.select("item_id", "num_hash",
                    L.band_size_col(F.col("num_hash"), F.lit(0.5), F.lit(0.9)).alias("rows_etp90"),
                    L.band_size_col(F.col("num_hash"), F.lit(0.8), F.lit(0.5)).alias("rows_etp50"))


ROWS = L.band_size(B, 0.5, 0.9)


def _sql_bands(rot: str, alias: str) -> str:
    return f"""{alias} AS (SELECT id, unnest(k) AS key, generate_subscripts(k, 1) - 1 AS band FROM (
  SELECT id, list_transform(range(0, ceil(len(sk) / {ROWS})::BIGINT), lambda b: md5(array_to_string(
          list_concat(sk, sk[1:{ROWS}])[b * {ROWS} + 1: b * {ROWS} + {ROWS}], ','))) AS k
  FROM (SELECT id, list(hash ORDER BY bucket) AS sk FROM {rot} GROUP BY id)))"""


@register("lsh_banded", f"""WITH {_sql_two_sketches()}, {_sql_bands('drot', 'db')}, {_sql_bands('qrot', 'qb')},
m AS (SELECT qb.id AS query_id, db.id AS doc_id, count(*)::DOUBLE AS score FROM qb JOIN db USING (band, key) GROUP BY qb.id, db.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def lsh_banded(spark, sf_dir):
    """Banded min-hash match (band size from L4 at s=0.5, target 0.9);
    score = equal bands; top-10 per benchmark passage."""
    dsk = L.sketch(_doc_shingles(spark, sf_dir), "id", "sh")
    qsk = L.sketch(_doc_shingles(spark, sf_dir, "benchmark", "item_id"), "id", "sh").withColumnRenamed("id", "query_id")
    r = L.banded_search(dsk, qsk, "id", ROWS)
    return r.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@register("lsh_recall")
def lsh_recall(spark, sf_dir):
    """recall@10 of the LSH top-10 against the exact shingle-Jaccard top-10."""
    from quarry.operators.search import top_k
    from quarry.session import checked_broadcast

    dsh = _doc_shingles(spark, sf_dir).select("id", F.explode_outer(F.array_distinct("sh")).alias("s")).dropna()
    qsh = _doc_shingles(spark, sf_dir, "benchmark", "item_id").select(
        F.col("id").alias("query_id"), F.explode_outer(F.array_distinct("sh")).alias("s")).dropna()
    dn = dsh.groupBy("id").agg(F.count(F.lit(1)).alias("dn"))
    qn = qsh.groupBy("query_id").agg(F.count(F.lit(1)).alias("qn"))
    inter = dsh.join(checked_broadcast(qsh), "s").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("i"))
    jac = inter.join(dn, "id").join(checked_broadcast(qn), "query_id").select(
        "query_id", "id", (F.col("i") / (F.col("dn") + F.col("qn") - F.col("i"))).alias("score"))
    exact = top_k(jac, 10, id_col="id").select("query_id", F.col("id").alias("doc_id"))
    approx = lsh_search(spark, sf_dir).select("query_id", "doc_id")
    hit = exact.join(approx, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    tot = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return tot.join(hit, "query_id", "left").select(
        "query_id", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall_at_10"))

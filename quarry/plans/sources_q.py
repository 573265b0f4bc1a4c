"""Sources and sinks.

File sources read files that Spark first writes from the driver tables into
the shared checkpoint folder (``spark.checkpoint.dir``), once per session:
documents as text lines, ``part`` as CSV, ``embeddings`` as an embedding text
file and as binary vectors — so every reader works on data that grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.corpus import global_ordinal
from quarry.plans import register
from quarry.plans.common import r6, tbl
from quarry.plans.corpus import SQL_PAIRS, _pairs
from quarry.session import checkpoint_dir
from quarry.sources import files as SF
from quarry.sources import markup as SX

COMMIT_EVERY = 10_000
_STAGED: dict = {}


def _staged(spark, sf_dir, name, write):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        tag = sf_dir.rstrip("/").rsplit("/", 1)[-1]
        path = f"{checkpoint_dir(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}/{tag}/{name}"
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


@register("scan_field", "SELECT doc_id, lower(text) AS sentence FROM documents")
def scan_field(spark, sf_dir):
    """One field's values with a pre-processor (lower case)."""
    return tbl(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("sentence"))


@register("scan_labelled", "SELECT 'doc_' || doc_id AS label, text FROM documents")
def scan_labelled(spark, sf_dir):
    """The field as labelled documents ``doc_<id>``."""
    return tbl(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
                                                  .alias("label"), "text")


def _sql_html_text(h):
    t = f"regexp_replace({h}, '(?s)<script[^>]*>.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<style[^>]*>.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@register("wiki_import", f"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS lang, {_sql_html_text('html')} AS text,
  list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, '{SX.CATEGORY_RE.replace("'", "''")}', 1),
    lambda c: string_split(regexp_replace(c, '{SX.CATEGORY_DROP_RE}', '', 'g'), '|'))), lambda c: c <> ''))) AS categories
FROM pages""")
def wiki_import(spark, sf_dir):
    """S3: pages → (title, lang, visible text, categories)."""
    p = SX.import_pages(tbl(spark, sf_dir, "pages"))
    return p.select("page_id", "title", "lang", "text", F.array_sort("categories").alias("categories"))


@register("tmx_pairs", f"WITH {SQL_PAIRS} SELECT conv_id, turn, source, target FROM pairs")
def tmx_pairs(spark, sf_dir):
    """Parallel pairs written as TMX ``<tu>`` units and parsed back by language."""
    p = _pairs(spark, sf_dir).select("conv_id", "turn", SX.tmx_unit_xml(F.col("source"), F.col("target"),
                                                                        "en-US", "it-IT").alias("xml"))
    u = p.select("conv_id", "turn", SX.parse_tmx_units(F.col("xml")).alias("tu"))
    return SX.tmx_pairs(u, "en-us", "it-it", "tu.tuv", keep=("conv_id", "turn"))


def _doc_lines(spark, sf_dir):
    def write(path):
        tbl(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.mode(
            "overwrite").text(path)
    return _staged(spark, sf_dir, "doc_lines", write)


@register("scan_lines", "SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents")
def scan_lines(spark, sf_dir):
    """Text lines of a file set, each with its position in file order."""
    lines = SF.read_lines(spark, _doc_lines(spark, sf_dir))
    return lines.select("line")


def _part_csv(spark, sf_dir):
    def write(path):
        tbl(spark, sf_dir, "part").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return _staged(spark, sf_dir, "part_csv", write)


@register("scan_csv", "SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size FROM part")
def scan_csv(spark, sf_dir):
    """CSV records, columns 0 and 4 (the part key and size)."""
    d = SF.read_delimited(spark, _part_csv(spark, sf_dir), (0, 4))
    return d.select(F.col(d.columns[0]).cast("long").alias("p_partkey"), F.col(d.columns[1]).cast("long").alias("p_size"))


def _emb_text(spark, sf_dir):
    def write(path):
        e = tbl(spark, sf_dir, "embeddings")
        n = e.count()
        dim = e.select(F.max(F.size("embedding"))).first()[0] or 0
        head = spark.createDataFrame([(f"{n} {dim} 0",)], "value string")
        body = SF.embedding_lines(e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("vector")))
        # one file for the header, which comes first there; vectors go to files of their own
        head.coalesce(1).write.mode("overwrite").text(path)
        body.write.mode("append").text(path)
    return _staged(spark, sf_dir, "emb_text", write)


_SQL_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


@register("read_embeddings", f"SELECT vec_id::VARCHAR AS label, {_SQL_VEC} AS vector FROM embeddings")
def read_embeddings(spark, sf_dir):
    """Embedding text file (header dropped) → (label, vector)."""
    return SF.read_embedding_file(spark, _emb_text(spark, sf_dir))


@register("decode_vectors", f"SELECT vec_id, {_SQL_VEC} AS vector FROM embeddings")
def decode_vectors(spark, sf_dir):
    """Vectors stored as big-endian float64 bytes decoded back to arrays."""
    e = tbl(spark, sf_dir, "embeddings").select(
        "vec_id", SF.encode_vectors(F.transform("embedding", lambda x: x.cast("double"))).alias("blob"))
    return e.select("vec_id", SF.decode_vectors("blob").alias("vector"))


@register("index_append", f"""SELECT batch_id, count(*)::BIGINT AS n_docs FROM (
  SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // {COMMIT_EVERY})::BIGINT AS batch_id FROM documents) GROUP BY 1""")
def index_append(spark, sf_dir):
    """K1/K2: documents appended in commits of 10 000 (doc_id order); one
    row per commit with its sequence number and size, read back from storage."""
    d = global_ordinal(tbl(spark, sf_dir, "documents"), [F.col("doc_id")], out="_o").withColumn(
        "batch_id", F.floor((F.col("_o") - 1) / COMMIT_EVERY).cast("long")).drop("_o")
    root = _staged(spark, sf_dir, "index_append", lambda path: None) + "/docs"
    r = SF.append_batches(d, root)
    return r.select(F.col("batch_id").cast("long"), F.col("n_docs").cast("long"))


COMMITS = 4


@register("commit_report", f"""SELECT batch_id, count(*)::BIGINT AS n_docs, true AS timed FROM (
  SELECT ((row_number() OVER (ORDER BY doc_id) - 1) * {COMMITS} // (SELECT count(*) FROM documents))::BIGINT AS batch_id
  FROM documents) GROUP BY 1""")
def commit_report(spark, sf_dir):
    """K2: documents appended in four commits (doc_id order), each counted and timed as it is written; one row per
    commit, ``timed`` tells that its seconds were measured."""
    docs = tbl(spark, sf_dir, "documents")
    n = docs.count()
    d = global_ordinal(docs, [F.col("doc_id")], out="_o").withColumn(
        "batch_id", F.floor((F.col("_o") - 1) * COMMITS / F.lit(max(n, 1))).cast("long")).drop("_o")
    r = SF.append_commits(d, _staged(spark, sf_dir, "commit_report", lambda path: None) + "/docs")
    return r.select("batch_id", "n_docs", (F.col("seconds") > 0).alias("timed"))


def _flatten_sql():
    from quarry.plans import _REGISTRY
    from quarry.plans import streams  # noqa: F401
    return _REGISTRY["flatten_results"][1]


@register("results_csv", _flatten_sql())
def results_csv(spark, sf_dir):
    """K3: the flattened ranker results written as CSV (overwrite) and read back."""
    from quarry.plans.streams import flatten_results

    path = _staged(spark, sf_dir, "results_csv", lambda p: None)
    SF.write_results_csv(flatten_results(spark, sf_dir), path)
    d = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return d.select(F.col("query_id").cast("long"), "ranker", "texts")


@register("upsert_vectors", f"""SELECT label, max(vec_id) AS vec_id, arg_max({_SQL_VEC}, vec_id) AS vector
FROM embeddings GROUP BY label""")
def upsert_vectors(spark, sf_dir):
    """K6: vectors put per label in vec_id order; the last write wins."""
    e = tbl(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform(
        "embedding", lambda x: x.cast("double")).alias("vector"))
    return SF.upsert(e, "label", "vector", "vec_id").select("label", "vec_id", "vector")

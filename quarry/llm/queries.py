"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (ann, bytebpe, chat, fixity, ftrl, neardup, packing, quality, repair, spans, spelling, urls,
                        wrappers)
from quarry.llm.common import stage

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_wrapper_extraction")
def op1(spark, sf_dir):
    """Main text of every page, by wrappers inferred per host."""
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


#: The rules of the URL query, and what marks a domain label as advertising or tracking.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]
LISTED_WORDS = "ads?|adserver|track(er|ing)?|spam|click"
#: Characters of html below which a page is thin; its address is listed.
THIN = 1500

_SQL_URL = f"""
WITH u AS (SELECT page_id, html, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS h,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, html, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
thin AS (SELECT DISTINCT host || path AS address FROM p WHERE length(html) < {THIN} AND host <> '' AND path <> ''),
l AS (SELECT r.*, regexp_matches(host, '(^|[.-])({LISTED_WORDS})([.-]|$)') OR coalesce(path <> '' AND address IS NOT NULL, false)
      AS listed FROM r LEFT JOIN thin ON address = host || path)
SELECT page_id, host, path, rule, listed, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM l"""


@_query("op2_bloom_cascade", _SQL_URL)
def op2(spark, sf_dir):
    """Verdict on every page's url; listed are the corpus's domains whose first label names ads or tracking, and the
    addresses of thin pages."""
    pages = _table(spark, sf_dir, "pages")
    address = F.concat(urls.host(F.col("url")), urls.path(F.col("url")))
    thin = pages.filter((F.length("html") < THIN) & (urls.path(F.col("url")) != "")).select(address.alias("domain"))
    seen = pages.select(F.explode(urls.domains(urls.host(F.col("url")))).alias("domain")).distinct()
    listed = seen.filter(F.element_at(F.split("domain", r"\."), 1).rlike(f"(^|-)({LISTED_WORDS})(-|$)"))
    return urls.judge(pages, URL_RULES, listed.unionByName(thin.filter(F.instr("domain", "/") > 1)))


@_query("op3_superminhash_dedup")
def op3(spark, sf_dir):
    """Near-duplicate classes of ``documents`` on two-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


@_query("op4_nn_descent")
def op4(spark, sf_dir):
    """The five nearest of every vector whose id is divisible by 50."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@_query("op5_sentence_span_dedup")
def op5(spark, sf_dir):
    """``documents`` without the sentence spans that occur earlier in the corpus."""
    return spans.dedup_spans(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_units", "n_removed",
                                                                       "removed")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with planted faults: of 97 page ids one is flipped in place, one cut short and one lost."""
    kind = F.pmod(F.col("page_id"), F.lit(97))
    half = F.floor(F.col("length") / 2).cast("int")
    first, rest = F.substring("record", F.lit(1), half), F.substring("record", half + 2, F.col("length").cast("int"))
    return records.filter(F.coalesce(kind != 13, F.lit(True))).withColumn(
        "record", F.when(kind == 7, F.concat(first, F.unhex(F.lit("00")), rest)).when(kind == 11, first)
        .otherwise(F.col("record")))


@_query("op6_merkle_fixity", """
SELECT page_id, CASE page_id % 97 WHEN 7 THEN 'changed' WHEN 11 THEN 'changed' WHEN 13 THEN 'missing' ELSE 'sound' END
  AS status FROM pages""")
def op6(spark, sf_dir):
    """Every page's WARC record with its status after an audit of a replica against the archive."""
    kept = stage(fixity.archive(_table(spark, sf_dir, "pages")), "archive")
    a = stage(fixity.leaves(kept), "leaves")
    b = stage(fixity.leaves(damaged(kept)), "leaves")
    found = fixity.audit(a, b).select(F.col("warc").alias("w"), F.col("offset").alias("o"), "status")
    places = kept.select("page_id", "warc", "offset")
    return (places.join(found, (F.col("warc") == F.col("w")) & (F.col("offset") == F.col("o")), "left")
            .select("page_id", F.coalesce("status", F.lit("sound")).alias("status")))


@_query("op7_best_fit_packing")
def op7(spark, sf_dir):
    """Every piece of every document with its place in the packed sequences."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op8_quality_rules")
def op8(spark, sf_dir):
    """Measures and verdict of every document, with cutoffs certified on ``labels``."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stratum", *[f"cut_{r}" for r in quality.LADDERS])


@_query("op9_sentencepiece_byte_bpe")
def op9(spark, sf_dir):
    """Every document encoded and decoded again."""
    import public_tokenizers

    return bytebpe.round_trip(_table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op10_relational_chat_format")
def op10(spark, sf_dir):
    """All conversations and conversation -7, formatted and read back."""
    extra = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


@_query("op11_ftrl_quality_classifier")
def op11(spark, sf_dir):
    """Every document's quality score, learned from the labels that are not held out."""
    return ftrl.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op12_spelling_variants")
def op12(spark, sf_dir):
    """Every frequent word of ``documents`` with its near words and the form it is a variant of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_query("op13_conversation_repair")
def op13(spark, sf_dir):
    """Faults, cheapest repair and digest of every conversation after planted damage."""
    return repair.audit_damaged(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

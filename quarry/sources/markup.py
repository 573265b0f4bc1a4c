"""wiki/HTML page import and TMX parallel corpora.

Files go through Spark's XML source (``format("xml")``, one record per
``rowTag`` element, split and parsed in parallel); XML already held in a
column goes through ``from_xml``. Both use the same column logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The category pattern of the wiki import and its clean-up.
CATEGORY_RE = r"\[Category:(\w+([\|\s']\w*)*)]"
CATEGORY_DROP_RE = r"\|\s|\|\*"


def categories(text: Column) -> Column:
    """S3: distinct categories of a page: every ``[Category:...]`` match,
    ``|`` + blank and ``|*`` removed, split at ``|``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CATEGORY_RE), 1)
    parts = F.transform(found, lambda c: F.split(F.regexp_replace(c, CATEGORY_DROP_RE, ""), r"\|"))
    return F.array_distinct(F.filter(F.flatten(parts), lambda c: c != ""))


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: script/style/comments dropped, tags
    replaced by blanks, blank runs collapsed."""
    t = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?s)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def import_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S3 over HTML pages: ``(page_id, title, lang, text, categories)``."""
    h = F.col(html_col)
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, r"<html[^>]*\blang=\"([^\"]*)\"", 1).alias("lang"),
        html_text(h).alias("text"), categories(h).alias("categories"))


def read_wiki_dump(spark: SparkSession, path: str, language: str) -> DataFrame:
    """S3 over a MediaWiki XML dump (plain or gzip): one record per ``page``,
    ``(title, text, categories, lang)``."""
    d = (spark.read.format("xml").option("rowTag", "page")
         .schema("title string, revision struct<text: struct<_VALUE: string>>").load(path))
    return d.select("title", F.col("revision.text._VALUE").alias("text"),
                    categories(F.col("revision.text._VALUE")).alias("categories"), F.lit(language).alias("lang"))


TMX_TU_SCHEMA = "tuv array<struct<`_xml:lang`: string, _lang: string, seg: string>>"


def tmx_sides(tuv: Column, source: str, target: str) -> list[Column]:
    """Last ``seg`` per language (``xml:lang``, falling back to ``lang``)."""
    lang = lambda t: F.lower(F.coalesce(t["_xml:lang"], t["_lang"]))
    pick = lambda code: F.try_element_at(F.transform(F.filter(tuv, lambda t: lang(t) == code.lower()),
                                                     lambda t: t["seg"]), F.lit(-1))
    return [pick(source).alias("source"), pick(target).alias("target")]


def tmx_pairs(units: DataFrame, source: str, target: str, tuv_col: str = "tuv", keep=()) -> DataFrame:
    """Translation units → ``(source, target)``, units with both sides only."""
    return (units.select(*keep, *tmx_sides(F.col(tuv_col), source, target))
            .filter(F.col("source").isNotNull() & F.col("target").isNotNull()))


def read_tmx(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """S4 over TMX files (plain or gzip; Spark picks the codec from the name)."""
    u = (spark.read.format("xml").option("rowTag", "tu").option("ignoreSurroundingSpaces", "false")
         .schema(TMX_TU_SCHEMA).load(path))
    return tmx_pairs(u, source, target)


def parse_tmx_units(xml: Column) -> Column:
    """Parse ``<tu>`` elements held in a string column."""
    return F.from_xml(xml, TMX_TU_SCHEMA, {"ignoreSurroundingSpaces": "false"})


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def tmx_unit_xml(source_text: Column, target_text: Column, source: str, target: str) -> Column:
    """A ``<tu>`` element holding two ``tuv`` sides with ``xml:lang`` (writer side of S4)."""
    def tuv(code, t):
        return [F.lit(f'<tuv xml:lang="{code}"><seg>'), xml_escape(t), F.lit("</seg></tuv>")]
    return F.concat(F.lit("<tu>"), *tuv(source, source_text), *tuv(target, target_text), F.lit("</tu>"))

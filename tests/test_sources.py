"""File sources: XML dump and TMX readers (plain and gzip), line order, embedding text format."""

import gzip
import os
import tempfile

from pyspark.sql import functions as F

WIKI = """<mediawiki>
<page><title>Alpha</title><revision><text>Alpha text [[Category:Physics|Mechanics]] and [Category:Physics|Optics] more [Category:Art]</text></revision></page>
<page><title>Beta</title><revision><text>No categories here.</text></revision></page>
</mediawiki>"""

TMX = """<tmx version="1.4"><body>
<tu><tuv xml:lang="en"><seg>hello &amp; welcome</seg></tuv><tuv xml:lang="it"><seg>ciao</seg></tuv><tuv xml:lang="it"><seg>salve</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg>only english</seg></tuv></tu>
<tu><tuv lang="EN"><seg>good night</seg></tuv><tuv lang="IT"><seg>buona notte</seg></tuv></tu>
</body></tmx>"""


def _write(path, text, gz=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def test_wiki_dump_categories(spark):
    from quarry.sources.markup import read_wiki_dump

    d = tempfile.mkdtemp(prefix="quarry-src-")
    _write(f"{d}/wiki/dump.xml", WIKI)
    rows = {r["title"]: r for r in read_wiki_dump(spark, f"{d}/wiki", "en").collect()}
    # "[[Category:..." also holds a "[Category:" match
    assert sorted(rows["Alpha"]["categories"]) == ["Art", "Mechanics", "Optics", "Physics"]
    assert rows["Beta"]["categories"] == []
    assert rows["Alpha"]["lang"] == "en"


def test_tmx_reader_gzip_last_segment_wins(spark):
    from quarry.sources.markup import read_tmx

    d = tempfile.mkdtemp(prefix="quarry-src-")
    _write(f"{d}/tmx/corpus.tmx.gz", TMX, gz=True)
    got = sorted((r["source"], r["target"]) for r in read_tmx(spark, f"{d}/tmx", "en", "it").collect())
    assert got == [("good night", "buona notte"), ("hello & welcome", "salve")]


def test_read_lines_keeps_file_order(spark):
    from quarry.sources.files import read_lines

    d = tempfile.mkdtemp(prefix="quarry-src-")
    _write(f"{d}/lines/a.txt", "\n".join(f"line {i}" for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, f"{d}/lines")
        assert lines.rdd.getNumPartitions() > 1
        got = [r["line"] for r in lines.orderBy("file", "block_start", "_mid").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(2000)]


def test_embedding_text_round_trip(spark):
    from quarry.sources.files import embedding_lines, parse_embedding_lines

    v = spark.createDataFrame([("a word", [0.5, -1.25]), ("b", [3.0, 0.0])], "label string, vector array<double>")
    lines = spark.createDataFrame([("2 2 0",)], "value string").unionByName(embedding_lines(v))
    assert any(r["value"].startswith("B64:") for r in lines.collect())
    got = sorted((r["label"], list(r["vector"])) for r in parse_embedding_lines(lines).collect())
    assert got == [("a word", [0.5, -1.25]), ("b", [3.0, 0.0])]


def test_binary_vectors_round_trip(spark):
    from quarry.sources.files import decode_vectors, encode_vectors

    v = spark.createDataFrame([(1, [0.1, 2.5e10, -3.0])], "k int, vector array<double>")
    b = v.select("k", encode_vectors("vector").alias("blob"))
    assert len(b.first()["blob"]) == 24
    assert list(b.select(decode_vectors("blob").alias("v")).first()["v"]) == [0.1, 2.5e10, -3.0]


def test_upsert_last_write_wins(spark):
    from quarry.sources.files import upsert

    puts = spark.createDataFrame([("s", 1, "old"), ("s", 3, "new"), ("s", 2, "mid"), ("t", 1, "x")],
                                 "seq string, version int, vec string")
    got = {r["seq"]: r["vec"] for r in upsert(puts, "seq", "vec", "version").collect()}
    assert got == {"s": "new", "t": "x"}

"""Analysers and small operators on literal fixtures (nulls, empties, unicode)."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.lsh import band_size


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first().x


def test_stop_words_keep_positions(spark):
    df = spark.createDataFrame([(0, "I like the search engines")], "doc_id long, text string")
    from quarry.operators.index import tokenize
    toks = tokenize(df, analyzer="whitespace").filter(~F.lower("term").isin("a", "an", "the"))
    assert [(r.pos, r.term) for r in toks.orderBy("pos").collect()] == [
        (0, "I"), (1, "like"), (3, "search"), (4, "engines")]


def test_standard_and_null(spark):
    assert one(spark, T.standard_tokens, "Héllo, Wörld 42!") == ["héllo", "wörld", "42"]
    assert one(spark, T.standard_tokens, None) == []
    assert one(spark, T.whitespace_tokens, "  a \t b ") == ["a", "b"]


def test_english(spark):
    assert one(spark, T.english_tokens, "The engines' cities and John's dogs") == ["engine", "city", "john", "dog"]


def test_specials(spark):
    assert one(spark, lambda c: T.special_tokens(c, True), "hi, there! (x)") == ["hi", ",", "there", "!", "(", "x", ")"]
    assert one(spark, lambda c: T.special_tokens(c, False), "hi, there! (x)") == ["hi", "there", "x"]


def test_prefixes_and_shingles(spark):
    assert one(spark, T.prefixes, "music") == ["m", "mu", "mus", "musi", "music"]
    assert one(spark, T.prefixes, "") == [""]
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],)], "t array<string>")
    got = [r.s for r in df.select(T.shingles(F.col("t"), 2, 3).alias("s")).collect()]
    assert got == [["a b", "b c", "c d", "a b c", "b c d"], []]


def test_feature_pipeline(spark):
    df = spark.createDataFrame([("1234, -5678 9",)], "text string")
    t = df.select(T.position_tokens(T.truncate_tokens(T.feature_tokens(F.col("text")), 3)).alias("t")).first().t
    assert t == ["1_123", "2_-56", "3_9"]


def test_char_filter(spark):
    assert one(spark, T.char_filter, "Ça va? «oui» 100%") == "a va? oui 100"


def test_band_size():
    assert band_size(512, 0.5, 0.9) == 5
    assert band_size(4, 0.0, 0.5) == 1


def test_char_grams_match_brute_force(spark):
    from quarry.operators.suggest import char_grams

    texts = ["abcd", "ab", "", None, "héllo\nwörld", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(char_grams(F.col("text"), 3).alias("g")).collect()]
    want = [None if t is None else [t[i:i + 3] for i in range(len(t) - 2)] for t in texts]
    assert got == want


def test_bigram_counts_match_position_join(spark):
    from collections import Counter

    from quarry.operators.index import tokenize
    from quarry.operators.suggest import bigram_counts, ngram_counts

    rows = [(1, "the cat sat on the mat"), (2, "the cat"), (3, "x"), (4, ""), (5, None), (6, "the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fast = Counter({(r.w1, r.w2): r.c for r in bigram_counts(df).collect()})
    _, bi = ngram_counts(tokenize(df))
    slow = Counter({(r.w1, r.w2): r.c for r in bi.collect()})
    assert fast == slow
    assert fast[("the", "cat")] == 2 and fast[("the", "the")] == 2

"""Quality rules: measures against brute force, the binomial test, and the guarantee on a holdout."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPLIT.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    hit = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_measures_match_brute_force():
    rnd = random.Random(4)
    alphabet = ["a", "b", "É", "#", "<x>", " y", " ", "\x1cz", "a b a b a", ""]
    seps = [" ", "\n", "\t", "\x0b", "\r\n", "  "]
    texts = ["".join(rnd.choice(alphabet) + rnd.choice(seps) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for t in [None, "", " \n ", "x", "a b c a b c", *texts]:
        assert quality.measure(t)[:5] == brute(t), repr(t)


def test_repeat_words_numbers_pairs_when_codes_are_many():
    words = [str(i % 700) for i in range(5000)]
    assert quality.repeat_words(words) == 5000


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.2), (3, 40, 0.1), (40, 40, 0.5), (7, 2000, 0.004)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
    assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_certified_stops_at_the_first_failure():
    assert quality.certified([0, 0, 400, 0], 5000, 0.01, 0.01) == 2
    assert quality.certified([0, 0], 50, 0.01, 0.01) == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)

    def text(bad):
        words = [f"w{rnd.randint(0, 900)}" + ("#$%"[rnd.randint(0, 2)] * 2 if bad and rnd.random() < 0.6 else "")
                 for _ in range(rnd.randint(60, 90))]
        return " ".join(words)

    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        rows.append((i, text(bad), "en" if i % 3 else "de", "x"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(6000, None, "en", "x"), (6001, "", None, "x"), (None, "few words", None, "x"),
             (7, rows[7][1], "en", "x")]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_bad_documents_go_and_good_ones_stay(corpus):
    docs, labels = corpus
    got = quality.judge(docs.drop("kept"), labels).toPandas()
    assert len(got) == docs.count()
    bad = (got["doc_id"] % 10 == 0) & (got["doc_id"] < 6000)
    assert not got[bad]["kept"].any()
    good = got[~bad & (got["doc_id"] < 6000)]
    assert (~good["kept"]).mean() <= quality.ALPHA
    assert got[got["n_words"] < 50]["base_failed"].all()


def test_keep_returns_the_columns_of_its_input(corpus):
    docs, labels = corpus
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 7").count() == 2 and kept.filter(F.col("doc_id").isNull()).count() == 0


def test_too_few_labels_certify_nothing(corpus):
    docs, labels = corpus
    got = quality.judge(docs, labels.limit(20))
    assert got.filter("not kept and not base_failed").count() == 0


def test_empty_tables(corpus):
    docs, labels = corpus
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter("kept").count() > 0

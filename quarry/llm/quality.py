"""Quality rules whose cutoffs carry a guarantee on false rejections.

One pass measures every whole text. The base rules reject by fixed limits. The other rules compare one measure with a
cutoff; each stratum gets its own cutoffs, taken from labelled documents so that, with confidence ``1 - delta`` over all
strata and rules together, at most ``alpha`` of the good documents of a stratum are rejected by all rules together.

How a cutoff is certified. A rule has a fixed ladder of cutoffs from lenient to strict, chosen without looking at data.
For a cutoff that rejects ``k`` of ``n`` labelled good documents the exact binomial test rejects "the true rate exceeds
a" when ``P(Bin(n, a) <= k) <= d`` (the Clopper-Pearson upper bound is then at most ``a``). The ladder is walked as a
fixed sequence and stops at the first cutoff that fails, which needs no correction inside the ladder; ``a = alpha /
rules`` (union bound over rules) and ``d = delta / (strata * rules)`` (Bonferroni) correct for the rest. All certified
cutoffs of a ladder hold at once, so the one that rejects the most labelled bad documents net of good ones may be
taken, the most lenient on a tie. A stratum with too few labels certifies nothing and loses nothing beyond the base
rules.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, one_by_one, stage, unused

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a stratum's good documents that the certified rules may reject, and the risk that a bound fails.
ALPHA = 0.02
DELTA = 0.05
#: measure -> cutoffs from lenient to strict; a document is rejected above the cutoff.
LADDERS = {
    "symbol_ratio": (4.0, 2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08),
    "upper_ratio": (0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_MEASURES = "doc_id long, stratum string, text_key long, " + ", ".join(f"{c} long" for c in _COUNTS)


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found at least twice in ``words``, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    code, uniq = pd.factorize(np.array(words, dtype=object))
    code = code.astype(np.int64)
    v = len(uniq)
    if v < 2_000_000:
        key = (code[:-2] * v + code[1:-1]) * v + code[2:]
    else:  # the product of three codes could wrap: number the pairs first
        pair = np.unique(code[:-2] * v + code[1:-1], return_inverse=True)[1].astype(np.int64)
        key = pair * v + code[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    eq = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of the staged columns."""
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII separators
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    return (len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines), upper)


def text_key():
    """Hash of a row's text, null like empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row of measures per row of ``docs`` (``doc_id, text`` and the stratum column), in one scan."""
    def run(batches):
        for b in batches:
            rows = np.array([measure(t) for t in one_by_one(b.column("text"))], np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("stratum"), b.column("text_key"), *map(pa.array, rows.T)],
                ["doc_id", "stratum", "text_key", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"),
                       text_key().alias("text_key"), "text").mapInArrow(run, _MEASURES)


def with_ratios(m: DataFrame) -> DataFrame:
    """Adds the base verdict and the measures that the ladders judge."""
    def ratio(a, b):
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return (m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .withColumn("symbol_ratio", ratio("n_symbols", "n_words"))
            .withColumn("upper_ratio", ratio("n_upper", "word_chars"))
            .withColumn("repeat_ratio", ratio("n_repeat_words", "n_words"))
            .withColumn("dup_line_ratio", ratio("n_dup_lines", "n_lines")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """``P(Bin(n, p) <= k)``, summed in logarithms."""
    if k >= n:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq
             for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def certified(counts: list[int], n: int, a: float, d: float) -> int:
    """How many cutoffs of a ladder are certified, from the lenient end; ``counts`` are the rejected good ones."""
    for i, k in enumerate(counts):
        if k > n * a or binomial_tail(k, n, a) > d:
            return i
    return len(counts)


def thresholds(m: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
               ladders: dict = LADDERS) -> DataFrame:
    """Certified cutoffs: one row per stratum with a column per rule (null: the rule rejects nothing there).

    ``m`` comes from :func:`with_ratios`; ``labels`` holds ``doc_id, quality`` (1 good). The holdout is every labelled
    good document that the base rules pass; a document labelled both ways counts as good. Nothing is sampled: the
    counts are one grouped aggregate, and the test runs on one row per stratum.
    """
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("good"))
    steps = [(r, i, c) for r, cs in ladders.items() for i, c in enumerate(cs)]

    def rejected(r, c, good):
        return F.sum(((F.col(r) > c) & (F.col("good") == good)).cast("long"))

    # an id that several rows share counts once, by its first row in a fixed order, so trials stay independent
    ratios = [F.col(r) for r in ladders]
    once = (m.filter(~F.col("base_failed")).join(marks, "doc_id").groupBy("doc_id")
            .agg(F.min(F.struct("stratum", *ratios, "good")).alias("one")).select("one.*"))
    counted = (once
               .groupBy("stratum").agg(F.sum("good").alias("n"),
                                       *[rejected(r, c, 1).alias(f"{r}_{i}") for r, i, c in steps],
                                       *[rejected(r, c, 0).alias(f"bad_{r}_{i}") for r, i, c in steps]))
    counted = stage(counted, "risk")
    tests = counted.count() * len(ladders)

    def cutoff(row, r):
        good, bad = ([int(row[f"{x}{r}_{i}"]) for i in range(len(ladders[r]))] for x in ("", "bad_"))
        sure = certified(good, int(row["n"]), alpha / len(ladders), delta / tests)
        gain, at = max(((bad[i] - good[i], -i) for i in range(sure)), default=(0, 0))
        return ladders[r][-at] if gain > 0 else None

    def run(batches):
        for b in batches:
            rows = b.to_dict("records")
            yield pd.DataFrame({"stratum": b["stratum"]} | {f"cut_{r}": [cutoff(x, r) for x in rows] for r in ladders})

    return counted.mapInPandas(run, "stratum string, " + ", ".join(f"cut_{r} double" for r in ladders))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
          delta: float = DELTA, ladders: dict = LADDERS) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null or empty texts have no words and fail the base rules. Null strata form a stratum of their own. A row whose
    ``doc_id`` is null or repeated is judged like any other. An empty table gives an empty result. ``docs`` may hold
    any other columns; only ``doc_id``, ``text`` and the stratum are read.
    """
    m = with_ratios(stage(measures(docs, stratum), "measures"))
    cuts = broadcast_if_small(thresholds(m, labels, alpha, delta, ladders)
                              .withColumnRenamed("stratum", "cut_stratum"), 256)
    j = m.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    bad = F.col("base_failed")
    for r in ladders:
        bad = bad | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return j.withColumn("kept", ~bad).drop("cut_stratum")


def keep(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns.

    Rejected rows are found by ``(doc_id, hash of the text)``, null-safe: rows that share an id but not a text are
    judged apart, and rows without an id are judged too.
    """
    rid, rkey = unused(docs, "rid", "rkey")
    out = (judge(docs, labels, **kw).filter(~F.col("kept"))
           .select(F.col("doc_id").alias(rid), F.col("text_key").alias(rkey)).distinct())
    out = broadcast_if_small(stage(out, "rejected"), 16)
    return docs.join(out, F.col("doc_id").cast("long").eqNullSafe(F.col(rid))
                     & (text_key() == F.col(rkey)), "left_anti")

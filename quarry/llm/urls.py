"""URL filtering: prefix rules first, then exact membership in a blocklist through a cascade of Bloom filters.

Level 1 encodes the listed keys. Level 2 encodes the unlisted keys that level 1 accepts by mistake, level 3 the listed
keys that level 2 accepts, and so on, until a level errs on nothing. The levels are built over the corpus's complete
key universe, so for every key of the corpus the answer is exact: a key is listed iff the first level that rejects it
is an even one, or all levels accept it and their number is odd. Pages are judged with one broadcast and no join.

The keys of a URL are its host and every parent domain. A cascade is cut into shards by key hash, each of a bounded
number of listed keys. If all shards fit the broadcast bound they travel together; otherwise the distinct keys are dealt
to their shard and judged there.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, mix64, stage

#: False-positive rate of every level after the first; the first errs on about as many keys as are listed.
LATER_RATE = 0.5


def first_rate(listed: int, unlisted: int) -> float:
    return min(LATER_RATE, max(1e-9, listed / (math.sqrt(2) * max(1, unlisted))))


def cascade_bytes(listed: int, unlisted: int) -> int:
    """Expected size: the first level, then levels of half the keys before at 1.44 bits each, with a margin of 25 %."""
    bits = listed * -1.4427 * math.log2(first_rate(listed, unlisted)) + 1.4427 * 3 * listed + 64 * 40
    return math.ceil(1.25 * bits / 8)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (null if none); a rule is ``(verdict, host + path)``.

    A rule fits its host and all subdomains, if the path starts with the rule's path. Equal lengths: the greater string.
    """
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def domains(host_: Column) -> Column:
    """A host and its parent domains, the longest first; none for an empty host."""
    parts = F.split(host_, r"\.")
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
            F.slice(parts, i, F.size(parts) - i + 1), ".")))


def names(host_: Column, path_: Column) -> Column:
    """What a list may name a url by: its domains, and its address (host and path) if it has a path."""
    address = F.when((host_ != "") & (path_ != ""), F.array(F.concat(host_, path_)))
    return F.concat(domains(host_), F.coalesce(address, F.array().cast("array<string>")))


def _asked(pages: DataFrame) -> Column:
    return names(F.col("host"), F.col("path")) if "path" in pages.columns else domains(F.col("host"))


class Cascade:
    """Levels of ``(bits, hashes, words)``; words are little-endian 64-bit blocks of the bit array."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]] | None = None):
        self.levels = levels or []

    def nbytes(self) -> int:
        return sum(w.nbytes for _, _, w in self.levels)

    @staticmethod
    def accepts(level, keys: np.ndarray, number: int) -> np.ndarray:
        bits, hashes, words = level
        a = mix64(keys + np.uint64(2 * number + 1))
        b = mix64(keys ^ np.uint64(0x5851F42D4C957F2D + number)) | np.uint64(1)
        out = np.ones(len(keys), bool)
        for i in range(hashes):
            at = (a + np.uint64(i) * b) % np.uint64(bits)
            out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Membership of key hashes; exact for keys of the universe the cascade was built over."""
        answer = np.full(len(keys), len(self.levels) % 2 == 1)
        live = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            ok = self.accepts(level, keys[live], number)
            answer[live[~ok]] = number % 2 == 1
            live = live[ok]
        return answer


def _filter(keys: DataFrame, n: int, rate: float, number: int) -> tuple[int, int, np.ndarray]:
    """One Bloom filter over a column ``key`` of 64-bit hashes: each task builds bits, which are joined by OR."""
    bits = max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    hashes = max(1, round(bits / n * math.log(2)))

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for x in batches:
            k = x["key"].to_numpy().view(np.uint64)
            a = mix64(k + np.uint64(2 * number + 1))
            b = mix64(k ^ np.uint64(0x5851F42D4C957F2D + number)) | np.uint64(1)
            for i in range(hashes):
                at = (a + np.uint64(i) * b) % np.uint64(bits)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pd.DataFrame({"word": at, "bits": words[at].view(np.int64)})

    got = (keys.mapInPandas(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
           .toPandas())
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits, hashes, words


def _on_keys(test):
    """A boolean UDF over 64-bit key hashes."""
    @F.pandas_udf("boolean")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(test(key.to_numpy().view(np.uint64)))

    return run


def build_cascade(universe: DataFrame, shard: int | None = None, shards: int = 1) -> Cascade:
    """A cascade from ``key long, listed boolean``, distinct keys; only keys of the given shard are taken.

    Filters, never keys, reach the driver; :func:`listed_urls` bounds their size by the number of shards.
    """
    if shards > 1:
        universe = universe.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
    levels = []
    own, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    while n := own.count():
        number = len(levels)
        levels.append(_filter(own, n, LATER_RATE if number else first_rate(n, other.count()), number))
        errs = _on_keys(functools.partial(Cascade.accepts, levels[-1], number=number))
        own, other = stage(other.filter(errs("key")), "cascade"), own
    return Cascade(levels)


def _contains(cascade, keys: np.ndarray) -> np.ndarray:
    return cascade.value.contains(keys)


def listed_urls(pages: DataFrame, listed: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``pages`` with ``hit boolean``: whether the host, a parent domain or the address is in ``listed``.

    ``pages`` holds ``host``, and ``path`` if addresses count; ``listed`` holds domains and addresses (host and path) as
    ``domain``, hosts in any case. The universe is every distinct domain and address of every row; what is listed but
    absent from the corpus is left out of it, since no row asks for it. Null names are ignored. Keys are counted first, and the
    number of shards is such that the filters of one stay inside ``budget`` bytes.
    """
    keys = pages.select(F.explode(_asked(pages)).alias("domain")).distinct()
    first = F.substring_index("domain", "/", 1)
    named = F.concat(F.lower(first), F.substring(F.col("domain"), F.length(first) + 1, F.length("domain")))
    marked = (keys.join(listed.select(named.alias("domain")).filter("domain is not null").distinct()
                        .withColumn("l", F.lit(True)), "domain", "left")
              .select(F.xxhash64("domain").alias("key"), F.coalesce("l", F.lit(False)).alias("listed")))
    # two domains of one hash, should that ever happen, count as listed if either is
    universe = stage(marked.groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    listed_n = universe.filter("listed").count()
    shards = -(-cascade_bytes(listed_n, universe.count() - listed_n) // budget)
    if shards == 1:
        cascade = pages.sparkSession.sparkContext.broadcast(build_cascade(universe))

        @F.pandas_udf("boolean")
        def any_listed(keys: pd.Series) -> pd.Series:
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            if not n.sum():
                return pd.Series(np.zeros(len(keys), bool))
            found = cascade.value.contains(np.concatenate(keys.to_list()).astype(np.int64).view(np.uint64))
            return pd.Series(np.bincount(np.repeat(np.arange(len(n)), n), found, len(n)) > 0)

        return pages.withColumn("hit", any_listed(F.transform(_asked(pages), lambda d: F.xxhash64(d))))
    # beyond the bound: one pass of the distinct keys per shard, then the few listed keys meet their rows
    hits = None
    for i in range(shards):
        is_listed = _on_keys(functools.partial(_contains, pages.sparkSession.sparkContext.broadcast(
            build_cascade(universe, i, shards))))
        part = (universe.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == i).filter(is_listed("key")).select("key"))
        hits = part if hits is None else hits.unionByName(part)
    hits = stage(hits, "listed-keys")
    own = _asked(pages)
    asked = F.xxhash64(F.array_join(own, " "))  # urls that ask for the same names are looked up once
    found = (pages.select(asked.alias("h"), own.alias("d")).distinct().select("h", F.explode("d").alias("d"))
             .join(hits, F.xxhash64("d") == F.col("key"), "left_semi").select("h").distinct().withColumn("y", F.lit(True)))
    return (pages.join(found, asked == F.col("h"), "left")
            .withColumn("hit", F.coalesce("y", F.lit(False))).drop("h", "y"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame,
          budget: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``; others are not read).

    The longest fitting rule decides; without one a URL is blocked if its host, a parent domain or its address (host and
    path) is in ``listed`` (``domain``), else allowed. Null urls and urls without ``://`` have an empty host and path and are allowed.
    Repeated rows and null ids are judged like any row; an empty table gives an empty result.
    """
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    p = p.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    p = listed_urls(p, listed, budget)
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("hit").alias("listed"))

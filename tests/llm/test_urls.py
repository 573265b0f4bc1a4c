"""URL rules and the Bloom cascade: exact over its universe, in one shard and in many."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]


def brute(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(r), r, v) for v, r in RULES for h, p in [r.split("/", 1)]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    parts = host.split(".")
    hit = bool(host) and any(".".join(parts[i:]) in listed for i in range(len(parts)))
    rule = max(fit) if fit else (0, None, "block" if hit else "allow")
    return host, path, rule[1], rule[2], hit


@pytest.mark.parametrize("budget", [1 << 20, 200])
def test_verdicts(spark, budget):
    rnd = random.Random(3)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "A", "x-y") for b in ("example", "foo", "Bar", "ads") for c in
             ("org", "com", "net", "COM")]
    rows = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/fr/', '/fr', '/de/1', '/es/x?/en/1', '/en/12', '#a', '?q://x/'])}")
            for i in range(400)]
    rows += [(None, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "http:///path"), (5, "a://b://c/d"),
             (6, "x\n://Foo.org/\n"), rows[0]]
    listed = {"ads.net", "foo.com", "x-y.bar.net", "www.example.com", "absent.example"}
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    keys = spark.createDataFrame([(x,) for x in listed] + [(None,), ("foo.com",)], "domain string")
    got = urls.judge(df, RULES, keys, budget)
    want = sorted((str(i), *map(str, brute(u, listed))) for i, u in rows)
    assert sorted(tuple(map(str, (r.page_id, r.host, r.path, r.rule, r.verdict, r.listed))) for r in got.collect()) == want


def test_cascade_is_exact(spark):
    df = spark.range(6000).select(F.xxhash64("id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade, p = urls.build_cascade(df), df.toPandas()
    assert (cascade.contains(p["key"].to_numpy().view(np.uint64)) == p["listed"].to_numpy()).all()
    assert len(cascade.levels) > 2 and cascade.nbytes() <= urls.cascade_bytes(858, 5142)


def test_nothing_listed_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "domain string")
    assert urls.judge(df, [], none).first().verdict == "allow"
    assert urls.judge(df.limit(0), RULES, none).count() == 0


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_addresses_are_listed_beside_domains(spark, budget):
    rows = [(i, f"http://h{i % 7}.org.{'ABC'[i % 3]}/p/{i % 501}?q={i}") for i in range(3000)] + [(-1, "http://h1.x"), (-2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    listed = [f"H{i % 7}.org.{'aBc'[i % 3]}/p/{i}" for i in range(0, 501, 5)] + ["x", "H2.org.b", "absent.com/p", None]
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], spark.createDataFrame([(x,) for x in listed], "domain string"),
                                                    budget).collect()}
    low = {x.partition("/")[0].lower() + "".join(x.partition("/")[1:]) for x in listed if x}
    for i, u in rows:
        h, _, p = (u or "").partition("://")[2].partition("?")[0].partition("/")
        h = h.lower()
        own = {h, *(h.split(".", k)[-1] for k in range(1, h.count(".") + 1)), f"{h}/{p}" if p else h}
        assert got[i] == ("block" if own & low else "allow"), u
    assert sum(v == "block" for v in got.values()) > 200

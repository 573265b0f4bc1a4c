"""Near duplicates: shingles, SuperMinHash, components and whole results against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from quarry.llm import neardup


def brute_sets(rows, k):
    out = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(k, len(words))
        out.append((i, {tuple(words[j:j + n]) for j in range(len(words) - n + 1)} if n else set()))
    return out


def brute(rows, k):
    sets, up = brute_sets(rows, k), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                u, v = find(i), find(j)
                up[max(u, v)] = min(u, v)
    return collections.Counter((i, len(a), None if i is None else find(i)) for i, a in sets)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    vocab = [f"W{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(40)] for _ in range(5)]
    out = []
    for i in range(300):
        noise = rnd.choice([0, 0.01, 0.03, 0.06, 0.1])
        words = [rnd.choice(vocab) if rnd.random() < noise else w for w in base[i % 5]]
        out.append((1000 - i if i % 2 else 5000 + i, " ".join(words)))
    for i in range(150):  # blends of two bases: sets that link with neither, one or both
        a, b = rnd.sample(base, 2)
        cut = rnd.randint(0, 40)
        out.append((9000 + i, " ".join(a[:cut] + b[cut:])))
    return out + [(20000, None), (20001, ""), (20002, " \n"), (20003, "One"), (20004, "one"), (20005, "é ONE"),
                  out[0], (out[1][0], "another text under the same id"), (None, out[2][1]), (None, None)]


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, k).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("k", [2, 5])
def test_large_buckets_are_split_by_rare_elements(spark, rows, k, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 6)
    monkeypatch.setattr(neardup, "RARE", 3)
    once = list({i: (i, t) for i, t in rows if i is not None}.values())
    got = neardup.near_duplicates(spark.createDataFrame(once, "doc_id long, text string"), k).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(once, k)


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_large_bucket_keeps_links_of_members_that_do_not_fit_its_pivot(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "LARGE", 1)
    monkeypatch.setattr(neardup, "RARE", 2)
    rnd, words = random.Random(seed), [f"w{i}" for i in range(400)]
    if seed is None:  # 80 and 95 link, 95 and 115 link, 80 and 115 do not fit
        sets = [words[:80], words[:95], words[:115]]
    else:  # chains that grow and shrink away from the pivot, with a few words replaced
        sets = [words[:80]] + [[rnd.choice(words) if rnd.random() < 0.02 else w for w in words[:n]]
                               for n in rnd.sample(range(40, 170), 40)]
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame([(7, 0, i, len(s)) for i, (_, s) in enumerate(brute_sets(rows, 1))],
                                    "key long, pivot long, node long, n long")
    links = neardup.resolve(spark.createDataFrame(rows, "doc_id long, text string"), members, 1, 80, False)
    edges = links[0]
    for x in links[1:]:
        edges = edges.unionByName(x)
    comp = {r.node: r.comp for r in neardup.components(edges).collect()}
    assert {i: comp.get(i, i) for i, _ in rows} == {i: c for i, _, c in brute(rows, 1)}


def test_large_group_of_near_copies(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(60)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(1500)] + [(5000 + i, f"alone {i} x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert all(got[i] == (0 if i < 1500 else i) for i in got) and len(got) == 1550


def test_signature_estimates_similarity():
    errors = []
    for seed in range(30):
        r = np.random.default_rng(seed)
        x = r.integers(0, 2**63, 800, dtype=np.uint64)
        y = np.concatenate([x[:700], r.integers(0, 2**63, 100, dtype=np.uint64)])
        sig = neardup.superminhash(np.concatenate([x, y]), np.repeat([0, 1], 800), 2)
        errors.append((sig[0] == sig[1]).mean() - 700 / 900)
    assert abs(np.mean(errors)) < 0.02


def test_signature_does_not_depend_on_chunks(monkeypatch):
    r = np.random.default_rng(3)
    e, owner = r.integers(0, 2**63, 3000, dtype=np.uint64), np.sort(r.integers(0, 20, 3000))
    whole = neardup.superminhash(e, owner, 20)
    monkeypatch.setattr(neardup, "_CHUNK", 97)
    assert (neardup.superminhash(e, owner, 20) == whole).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long").repartition(7)
    got = {r.node: r.comp for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")
    got = neardup.keep_one(df, 5)
    assert got.columns == df.columns
    want = {c for _, _, c in brute(rows, 5) if c is not None}
    ids = [r.doc_id for r in got.collect()]
    assert collections.Counter(i for i in ids if i is not None) == dict.fromkeys(want, 1)
    assert ids.count(None) == 2
    assert neardup.keep_one(df.limit(0)).count() == 0

"""Merkle audit: damage found equals a direct comparison; archives lay records out without gaps."""

import random

import pytest

from quarry.llm import fixity

SCHEMA = "warc string, offset long, record binary"


@pytest.fixture(scope="module")
def replica():
    rnd = random.Random(1)
    return [(f"f{f}", o * 100, bytes(rnd.randint(0, 255) for _ in range(rnd.randint(0, 90))))
            for f in range(6) for o in range(rnd.randint(1, 500))]


@pytest.mark.parametrize("seed", [2])
def test_damage_equals_direct_comparison(spark, replica, seed):
    rnd = random.Random(seed)
    other = [(w, o, x + b"!" if rnd.random() < 0.01 else x) for w, o, x in replica if rnd.random() > 0.01]
    other += [("f1", 50, b"zz"), ("new", 0, b"q"), ("f0", 10**6, b"far")][:seed + 1]
    a, b = (spark.createDataFrame(x + x[:seed], SCHEMA) for x in (replica, other))
    got = {(r.warc, r.offset): r.status for r in fixity.audit(fixity.leaves(a), fixity.leaves(b), 300).collect()}
    x, y = ({(w, o): r for w, o, r in z} for z in (replica, other))
    assert got == {k: "missing" if k not in y else "extra" if k not in x else "changed"
                   for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


def test_sound_and_empty_replicas(spark, replica):
    a = fixity.leaves(spark.createDataFrame(replica, SCHEMA))
    none = a.limit(0)
    assert fixity.audit(a, a).count() == 0 and fixity.audit(none, none).count() == 0
    gone = fixity.audit(a, none, 300).collect()
    assert {r.status for r in gone} == {"missing"} and len(gone) == len(replica)


def test_roots_follow_every_byte(spark, replica):
    def root(rows):
        leaf = fixity.leaves(spark.createDataFrame(rows, SCHEMA))
        return {r.warc: r.root for r in fixity.roots(fixity.tree(leaf, fixity.reach(leaf), 300)).collect()}

    w, o, x = replica[3]
    before, after = root(replica), root([*replica[:3], (w, o, x + b"\0"), *replica[4:]])
    assert {k for k in before if before[k] != after[k]} == {w}


def test_archive_lays_records_out(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 50)) for i in range(300)] + [(None, None, None), (1, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, warc string")
    got = sorted(fixity.archive(df, 4000).collect(), key=lambda r: (r.warc, r.offset))
    assert len(got) == len(rows)
    at = {}
    for r in got:
        assert r.offset == at.get(r.warc, 0) and r.length == len(r.record)
        at[r.warc] = r.offset + r.length
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(head.rsplit(b": ", 1)[1]) == len(body) - 4
    assert len(at) > 1 and fixity.archive(df.limit(0)).count() == 0


def test_replicas_without_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    full = fixity.leaves(fixity.archive(pages))
    empty = fixity.leaves(fixity.archive(pages.limit(0)))
    assert fixity.audit(empty, empty).collect() == []
    assert [r.status for r in fixity.audit(full, empty).collect()] == ["missing"]
    assert [r.status for r in fixity.audit(empty, full).collect()] == ["extra"]
    assert fixity.audit(full, full).collect() == []

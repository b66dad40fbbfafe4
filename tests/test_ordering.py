"""Chunked and distributed order helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import ordering as o


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    # key 0 holds a third of all rows and spans several chunks
    rows = [(0, i, rnd.randint(0, 50) / 4) for i in range(1400)] + [(1 + i % 7, i // 7, rnd.randint(0, 50) / 4) for i in range(2100)]
    return rows, spark.createDataFrame(rows, "k long, pos long, v double").repartition(6)


def per_key(rows):
    out = {}
    for k, p, v in sorted(rows):
        out.setdefault(k, []).append(v)
    return out


def test_running_and_numbered(data):
    rows, df = data
    got = {(r.k, r.pos): (r.s, r.n) for r in o.numbered(o.running(df, ["k"], ["pos"], F.col("v"), "s", o.position_chunk("pos")), ["k"], ["pos"], "n", o.position_chunk("pos")).collect()}
    for k, vs in per_key(rows).items():
        total = 0.0
        for i, v in enumerate(vs):
            total += v
            assert got[(k, i)] == (pytest.approx(total), i)


@pytest.mark.parametrize("g", [0.0, 0.3, 0.95, 1.0])
def test_discounted_suffix_spans_chunks(data, g):
    rows, df = data
    got = {(r.k, r.pos): r.x for r in o.discounted_suffix(df, ["k"], "pos", "v", g, "x").collect()}
    for k, vs in per_key(rows).items():
        acc = 0.0
        for i in range(len(vs) - 1, -1, -1):
            acc = vs[i] + g * acc
            assert got[(k, i)] == pytest.approx(acc, rel=1e-9, abs=1e-9)


def test_ranked_and_prefix_sums(data):
    rows, df = data
    got = {(r.k, r.pos): (r.r, r.s) for r in o.ranked_running(df, ["k"], [F.desc("v"), "pos"], "r", {"s": "v"}).collect()}
    for k, vs in per_key(rows).items():
        total = 0.0
        for n, (i, v) in enumerate(sorted(enumerate(vs), key=lambda t: (-t[1], t[0])), 1):
            total += v
            assert got[(k, i)] == (n, pytest.approx(total))
    assert sorted(r.r for r in o.ranked(df, [], ["v", "k", "pos"], "r").collect()) == list(range(1, len(rows) + 1))


def test_average_rank_shares_ties(data):
    rows, df = data
    got = {(r.k, r.pos): r.a for r in o.average_ranked(df, ["k"], "v", "a").collect()}
    for k, vs in per_key(rows).items():
        s = sorted(vs)
        for i, v in enumerate(vs):
            first = s.index(v) + 1
            assert got[(k, i)] == first + (s.count(v) - 1) / 2


def test_hash_rank_is_a_permutation_and_independent_of_partitioning(data, spark):
    rows, df = data
    a = rows_of(o.hash_ranked(df, ["k"], "s", ["pos"], "r"), "k", "pos", "r")
    b = rows_of(o.hash_ranked(df.coalesce(1), ["k"], "s", ["pos"], "r"), "k", "pos", "r")
    assert a == b
    for k, vs in per_key(rows).items():
        assert sorted(r for kk, _, r in a if kk == k) == list(range(1, len(vs) + 1))


def test_carried_forward_crosses_partitions(spark):
    rows = [(i, i if i % 40 == 3 else None) for i in range(500)]
    got = {r.i: r.x for r in o.carried_forward(spark.createDataFrame(rows, "i long, v long").repartition(5), ["i"], "v", "x").collect()}
    assert got == {i: ((i - 3) // 40 * 40 + 3 if i >= 3 else None) for i in range(500)}


def test_numbered_led_crosses_chunks(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([None, 1, 2]), t, rnd.choice([None, "a", "b"])) for t in rnd.sample(range(2000), 300)] + [(3, 7, "alone"), (4, None, "x"), (4, 900, "y")]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = o.numbered_led(df, ["k"], ["t"], "n", F.floor(F.col("t") / 100), {"w": "v"})
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1]))
        want += [(k, r[1], r[2], n, mine[n + 1][2] if n + 1 < len(mine) else None, n + 1 < len(mine)) for n, r in enumerate(mine)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in ("k", "t", "v", "n", "w", "has_next")) for r in got.collect()), key=key) == sorted(want, key=key)

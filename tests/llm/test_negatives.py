"""Hard negatives against a plain version that compares every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import negatives


def plain(rows, step, positives=5, wanted=3, low=50, high=95):
    kept = {}
    d = len(min((r for r in rows if r[1] and r[0] is not None and r[2] is not None), key=lambda r: r[0])[1])
    for i, v, lab in rows:
        if i is not None and lab is not None and v and len(v) == d and all(c is not None and math.isfinite(c) for c in v):
            kept.setdefault(i, (lab, [math.floor(256 * c) for c in v]))
    out = []
    for a, (lab, g) in kept.items():
        if a % step:
            continue
        s = sorted((-sum(x * y for x, y in zip(g, h)), o, m == lab) for o, (m, h) in kept.items() if o != a)
        for ps, p, _ in [x for x in s if x[2]][:positives]:
            fit = [(n, o) for n, o, same in s if not same and low * -ps <= 100 * -n <= high * -ps]
            out += [(a, p, k + 1, o, -ps, -n) for k, (n, o) in enumerate(fit[:wanted])]
    return sorted(out)


def table(seed, n=400, d=6):
    """Clusters of directions, lengths of all sizes, copies in one large group, ties, zero vectors and odd rows."""
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    rows = []
    for i in range(n):
        m, size = rng.choice(middle), rng.choice([0.05, 0.3, 1, 1, 4])
        v = [size * (c + rng.gauss(0, 0.3)) for c in m]
        if i % 3 == 0:
            v = [0.5, 0.25] + [0.125] * (d - 2)
        if i % 17 == 0:
            v = [0.0] * d
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 3])))
    rows += [(1000, [1.0] * d, None), (1001, None, 1), (1002, [float("nan")] * d, 1), (1003, [None] * d, 1), (1004, [1.0], 1), (None, [1.0] * d, 1), (1005, [float("-inf")] * d, 2), (1006, [], 2), rows[5], rows[6],
             (1010, [-c for c in middle[0]], 77)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label long, id string, slot int, score int"


@pytest.mark.parametrize("seed,pack,block,first", [(1, 256, 2048, 2), (2, 7, 16, 1), (3, 5, 50, 2)])
def test_equals_plain(spark, monkeypatch, seed, pack, block, first):
    monkeypatch.setattr(negatives, "PACK", pack)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "FIRST", first)
    monkeypatch.setattr(negatives, "STRETCH", 8)
    monkeypatch.setattr(negatives, "MEMBERS", 6)
    monkeypatch.setattr(negatives, "LANE", 2)
    rows = table(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5)


def test_text_labels_and_large_values(spark):
    rows = [(i, [x * 4e4 for x in v] if v and None not in v else v, lab) for i, v, lab in table(4, 60) if i != 1010]
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame([(i, v, None if lab is None else f"label {lab}", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label string, code int")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 5 == 0).collect()) == plain(rows, 5)


def test_empty_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in table(1, 30)], SCHEMA)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 5 == 0).collect() == []
    assert negatives.hard_negatives(df, F.col("id") < 0).collect() == []
    assert negatives.hard_negatives(df.filter("vec_id = 5"), F.col("id") % 5 == 0).collect() == []


def test_walks_stop_early():
    """Where rows lie in clusters, members are certified after a small part of the list; without the bound they walk it all."""
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((10, 16))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    g = np.floor(256 * (np.repeat(middle, 200, 0) + 0.02 * rng.standard_normal((2000, 16)))).astype(np.int64)
    block = {"id": np.arange(2000), "label": np.zeros(2000, np.int64), "g": g}
    members = g[:40]
    pack = {"id": np.arange(40), "label": np.zeros(40, np.int64), "norm": np.sqrt((members * members).sum(1)), "g": members, "lo": np.full((40, 1), negatives.LEAST), "hi": np.full((40, 1), negatives.MOST), "kth": np.full((40, 1), negatives.LEAST)}
    angle = np.arccos(np.clip((members / pack["norm"][:, None]) @ middle[0], -1, 1)).max()
    bound = negatives._bounds(g, middle[:1], np.array([angle]))[:, 0]
    order = np.argsort(-bound, kind="stable")
    hits, walked = negatives.walk(block, pack, order, bound[order], 5, True)
    every, all_walked = negatives.walk(block, pack, order, np.full(2000, np.inf), 5, True)
    assert all((a == b).all() for a, b in zip(hits, every)) and all_walked == 80_000 and walked <= 20_000

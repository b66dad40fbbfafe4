"""Approximate nearest neighbours against a comparison with all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import neighbours


def table(seed, n=500, d=8):
    """Clusters, copies in a large group, lengths of all sizes, and odd rows."""
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    rows = []
    for i in range(n):
        m, size = rng.choice(middle), rng.choice([0.1, 1, 1, 1, 3])
        v = [size * (c + rng.gauss(0, 0.5)) for c in m]
        rows.append((i, [0.5, -0.25] + [1.0] * (d - 2) if i % 4 == 1 else v, 0))
    return rows + [(1000, None, 0), (1001, [0.0] * d, 0), (1002, [None] * d, 0), (1003, [float("nan")] * d, 0), (1004, [float("inf")] * d, 0), (1005, [1.0], 0), (1006, [], 0), (None, [1.0] * d, 0), rows[3], rows[-1]]


def exact(rows, step, k):
    kept = {i: v for i, v, _ in rows if i is not None and i < 1000}
    ids, x = np.array(sorted(kept)), np.array([kept[i] for i in sorted(kept)])
    out = {}
    for a in np.flatnonzero(ids % step == 0):
        s = np.zeros(len(ids))
        for c in range(x.shape[1]):
            s += x[:, c] * x[a, c]
        by = np.lexsort((ids, -s))
        out[int(ids[a])] = [(int(ids[j]), float(s[j])) for j in by if j != a][:k]
    return out


SCHEMA = "vec_id long, embedding array<double>, query long, node string, s int"


def test_recall_order_and_scores(spark):
    rows = table(1)
    df = spark.createDataFrame([(i, v, q, "n", 1) for i, v, q in rows], SCHEMA).repartition(3)
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, F.col("id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]]) and r["recall"] >= 0.95
    want = exact(rows, 5, 20)
    assert set(got) == set(want)
    every = exact(rows, 5, 10**6)
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found)
        true = dict(every[q])
        assert all(s == true[v] for v, s in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(i, v, q, "n", 1) for i, v, q in table(2, 6)], SCHEMA)
    got = neighbours.nearest_neighbours(df, F.col("id") % 5 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(a, b) for a in (0, 5) for b in range(6) if a != b]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("id") % 5 == 0).collect() == []
    assert neighbours.nearest_neighbours(df, F.col("id") < 0).collect() == []
    assert neighbours.nearest_neighbours(df.filter("vec_id > 999"), F.col("id") % 5 == 0).collect() == []


def test_unreachable_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STALLED", 1)
    df = spark.createDataFrame([(i, v, q, "n", 1) for i, v, q in table(3, 40)], SCHEMA)
    with pytest.raises(RuntimeError):
        neighbours.nearest_neighbours(df, F.col("id") % 5 == 0, least_recall=1.1)


def test_a_block_meets_a_node_once(spark, monkeypatch):
    """Over all rounds a vector is sent to a block of queries once at most, never again to each query."""
    sent, scored = [], neighbours._scored

    def seen(pairs, *more):
        sent.extend(map(tuple, pairs.collect()))
        return scored(pairs, *more)

    monkeypatch.setattr(neighbours, "_scored", seen)
    monkeypatch.setattr(neighbours, "EXPANDED", 4)
    monkeypatch.setattr(neighbours, "LEAST", 8)
    df = spark.createDataFrame([(i, v, q, "n", 1) for i, v, q in table(4, 600)], SCHEMA)
    got = neighbours.nearest_neighbours(df, F.col("id") % 5 == 0)
    assert got.select("query_id").distinct().count() == 120
    assert len({b for b, _ in sent}) > 1 and len(sent) == len(set(sent))

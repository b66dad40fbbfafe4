"""Vector code compression against a plain version that compares every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from wayfold.llm import codes


def plain(rows, parts, entries, rounds):
    """rows: (id, vector, label); the results in the order of the rows that take part."""
    first = min((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0]))
    d = len(first[1])
    kept = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows
            if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and max(map(abs, v)) < 1 << 20]
    w = d // parts
    cut = lambda g: [tuple(g[p * w:(p + 1) * w]) for p in range(parts)]
    seeds = {}
    for i, g, _ in kept:
        if i is not None:
            seeds[i] = min(g, seeds.get(i, g))
    books = [[cut(seeds[i])[p] for i in sorted(seeds)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, g, _ in kept:
            for p, x in enumerate(cut(g)):
                groups[p].setdefault(near(p, x)[1], []).append(x)
        books = [[tuple(sum(c) // len(m) for c in zip(*m)) if (m := groups[p].get(k)) else e for k, e in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, g, lab in kept:
        hits = [near(p, x) for p, x in enumerate(cut(g))]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in hits), sum(f for f, _ in hits)))
    total = {}
    for r in out:
        total[r[1]] = total.get(r[1], 0) + r[3]
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return [(*r, total[r[1]]) for r in out], hashlib.sha256(flat.encode()).hexdigest()


def table(seed, n=150, d=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), rng.randint(-3, 3) / 8, 0.0]) for _ in range(d)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(500, None, 1), (501, [0.1] * (d - 1) + [None], 1), (502, [float("nan")] * d, 1), (503, [float("inf")] + [0.0] * (d - 1), 2), (504, [], 1), (505, [0.5] * 4, 1),
             (None, [0.25] * d, 1), (506, [0.0] * d, None), (7, rows[7][1], 3), (9, [-9.0] * d, 0), (507, [-900.5] * d, 2), (508, [3e6] * d, 2)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, id string, code int"


@pytest.mark.parametrize("parts,entries,side_bits,cells", [(4, 16, 4, 1 << 15), (2, 64, 2, 1 << 15), (8, 7, 6, 5), (1, 200, 12, 100)])
def test_equals_plain(spark, monkeypatch, parts, entries, side_bits, cells):
    monkeypatch.setattr(codes, "CELLS", cells)
    rows = table(parts)
    want, digest = plain(rows, parts, entries, 2)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    r, books = codes.compress(df, parts=parts, entries=entries, side_bits=side_bits)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(x) for x in r.collect()), key=key) == sorted(want, key=key)
    assert codes.digest(books) == digest


def test_dominated_entries_never_win(spark):
    """The cached entries of a cell hold the nearest of every point of its box; far ones are left out."""
    rng = np.random.default_rng(5)
    book = rng.integers(-200, 200, (64, 3))
    cells = codes.Cells(book, 4, 1 << 15)
    x = rng.integers(-250, 250, (3000, 3))
    near, far = cells.nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (near == every.argmin(1)).all() and (far == every.min(1)).all()
    assert cells.count.mean() < 10


def test_odd_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in table(1)], SCHEMA)
    r, books = codes.compress(df.limit(0), parts=4)
    assert r.collect() == [] and books.size == 0
    r, _ = codes.compress(df.filter("vec_id = 502"), parts=4)
    assert r.collect() == []
    r, books = codes.compress(df.filter("vec_id IN (506, 507)"), parts=4)
    assert sorted((x["id"], x["code"], x["error"]) for x in r.collect()) == [(506, "00000000", 0), (507, "01010101", 0)]
    back = codes.decompress(r, books).collect()
    assert {x["id"]: x["vector"][0] for x in back} == {506: 0.5 / 256, 507: (math.floor(-900.5 * 256) + 0.5) / 256}
    with pytest.raises(ValueError):
        codes.compress(df, parts=3)

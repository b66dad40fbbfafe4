"""Line dedup against all pairs of lines by the plain edit distance."""

import random

import numpy as np
import pyarrow as pa

from wayfold.llm import lines as op


def distance(a, b):
    return op._small(a, b)


def test_banded_distance_agrees_with_the_plain_one():
    rng = random.Random(1)
    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            k, at = rng.randint(0, 2), rng.randint(0, len(b))
            if k == 0:
                b.insert(at, rng.choice(b"abc"))
            elif at < len(b):
                if k == 1:
                    del b[at]
                else:
                    b[at] = rng.choice(b"abc")
        for most in (1, 2, 3):
            assert op.within(a, bytes(b), most) == (distance(a, bytes(b)) <= most), (a, bytes(b), most)


def test_spans_cut_at_line_ends_and_texts():
    texts = ["a\nbc\n", "", "\n\n", "x"]
    starts, ends, first = op._spans(*op.flat(pa.array(texts)))
    data = "".join(texts)
    assert [[data[s:e] for s, e in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])] == [t.split("\n") for t in texts]


def brute(rows):
    """rows: (id, text) with unique ids."""
    every = [(i, p, x.encode()) for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None) for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    gone = set()
    for k, (i, p, x) in enumerate(every):
        for _, _, y in every[:k]:
            if x == y or (min(len(x), len(y)) >= op.LEAST_BYTES and abs(len(x) - len(y)) <= op.TAU and distance(x, y) <= op.TAU):
                gone.add((i, p))
                break
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows if i is not None}


def test_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(15, 60))) for _ in range(25)]

    def edited(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(x) - 1)
            x[at: at + rng.randint(0, 1)] = rng.choice(["", "z", "b"])
        return "".join(x)

    rows = [(i, "\n".join([edited(rng.choice(base)) for _ in range(rng.randint(0, 6))] + ["", "short", "  "])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "w" * 900 + "\n" + "w" * 901), (None, "short\nshort")]
    df = spark.createDataFrame([(a, b, 9, "x") for a, b in rows], "doc_id long, text string, n_lines int, id string")
    got = op.dedup_lines(df).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None} == want and len(got) == len(rows)
    assert [r["text"] for r in got if r["doc_id"] is None] == ["short\nshort"]
    assert set(got[0].asDict()) == {"doc_id", "text", "n_lines", "id", "n_removed"}


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.dedup_lines(empty).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\na")] * 2 + [(2, "b")], "doc_id long, text string")
    assert sorted(r["text"] for r in op.dedup_lines(twice).collect()) == ["", "a\nb", "a\nb"]


def test_different_texts_under_one_id(spark):
    """Positions of one row mean nothing in another row of the same id, nor in the next document."""
    long = [f"line number {i} of the long text {i * 7919}" for i in range(9)]
    near = "a line of some length that nearly repeats"
    texts = [(1, "\n".join(long)), (1, "short one\n" + near), (2, "\n".join(["short one", long[8], long[3], "own", near + "!"]))]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"], r["text"]) for r in op.dedup_lines(df).collect()) == sorted([texts[0], texts[1], (2, "own")])


def family(n, seed):
    """``n`` lines that share a third, most of them within two edits of the first, the others unlike."""
    rng = random.Random(seed)
    base = "the same notice ends every page of this site, no. "
    out = [base + "0000"]
    for k in range(1, n):
        x = list(base + "0000")
        for _ in range(rng.randint(1, 2) if k % 5 else 9):
            x[rng.randint(20, len(x) - 1)] = rng.choice("abcdefghij")
        out.append("".join(x))
    return out


def test_a_hot_segment_equals_brute_force(spark):
    lines = family(120, 2)
    rows = [(i, "\n".join(lines[(7 * i + j) % len(lines)] for j in range(3))) for i in range(60)]
    rows += [(100 + i, lines[0]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["text"] for r in op.dedup_lines(df).collect()}
    assert got == brute(rows)


def test_pairs_of_a_hot_segment_grow_with_its_lines(spark):
    def pairs(n):
        d = spark.createDataFrame([(i, x, i) for i, x in enumerate(family(n, 3))], "id long, text string, row long").repartition(5)
        firsts = op.occurrences(d).groupBy("h").agg(op.F.min("id").alias("id")).withColumn("row", op.F.col("id")).withColumn("pos", op.F.lit(0))
        return op.candidates(d, op.materialize(firsts))[0].count()

    assert pairs(1000) <= 15 * max(pairs(100), 100)


def test_keys_without_a_second_line_are_not_written(spark, monkeypatch):
    written = []

    def counted(df, write=op.materialize):
        r = write(df)
        written.append(r.count())
        return r

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)), i) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, text string, row long").repartition(5)
    firsts = op.materialize(op.occurrences(d).select("h", "id", "row", "pos"))
    monkeypatch.setattr(op, "materialize", counted)
    pairs, gone = op.candidates(d, firsts)
    assert pairs.count() == 0 and gone is None and max(written) == 0


def test_places_that_grow_with_the_texts_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, f"a line of the text {i}\nthe same") for i in range(50)], "doc_id long, text string")
    r = op.dedup_lines(df)
    assert sum(x["n_removed"] for x in r.collect()) >= 49
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin [id" not in plan

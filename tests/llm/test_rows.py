"""URL filter, mixing, media and quality against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import media, mixing, quality, urls
from wayfold.llm.queries import ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- URLs ------------------------------------------------------------------------------------
def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict
    q = re.sub("^&", "", re.sub("(^|&)utm_[^&]*", "", m[3] or ""))
    canonical = re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + q if q else "")
    return host, path, None, "block" if host and canonical in listed else "allow"


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "http://NET/", "http://x.net", "http://a.example.net/en/1", "https://example.net/en", "http://bexample.com/de/1", "http://q.example.com/de/1?x#y", "ftp://org/fr/", "http://org?x=://net/",
             "http://www.Bad.org/a/?utm_source=z", "http://bad.org/a", "http://bad.org/a?b=1&utm_x=2", "http://bad.org/a?b=1", "http://ß.org/Ä", "http://h" + "x" * 5000 + ".net/", "http://bad.org/a\n"]
    listed = spark.createDataFrame([("https://bad.org/a",), ("http://bad.org/a?b=1",), (None,), ("http://bad.org/a",)], "url string")
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(given + given)] + [(None, "http://bad.org/a", "c")], "page_id long, url string, host string")
    got = urls.judge_urls(df, urls.canonical_urls(listed), URL_RULES).collect()
    assert len(got) == 2 * len(given) + 1
    for r in got:
        u = "http://bad.org/a" if r["id"] is None else given[r["id"] % len(given)]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(u, {"bad.org/a", "bad.org/a?b=1"}), u
    assert urls.judge_urls(df.limit(0), urls.canonical_urls(listed), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df.filter("url like '%bad%'"), urls.canonical_urls(listed.limit(0)), URL_RULES).collect()} == {"allow"}


def test_bloom_filter_passes_every_listed_url(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"))
    f = urls.bloom_filter(listed, 20)
    cond = F.col("block") == F.col("at")
    for i in range(urls.WORDS):
        cond = cond & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    seen = lambda df: urls._hashed(df, 20).join(f, cond).count()
    assert seen(listed) == 3000
    assert urls._hashed(listed, 400).join(urls.bloom_filter(listed, 400), cond).count() == 3000
    other = spark.range(3000).select(F.concat(F.lit("other/"), F.col("id").cast("string")).alias("canonical"))
    assert urls._hashed(other, 400).join(urls.bloom_filter(listed, 400), cond).count() < 60


@tables
def test_urls_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.execute(ORACLES["op3_url_filters"])
    names = [c[0] for c in rel.description]
    got = QUERIES["op3_url_filters"](spark, SF)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


# --- mixing ----------------------------------------------------------------------------------
def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """sizes by source; null last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    held = {}
    while True:
        left = share * sum(sizes.values()) - sum(held.values())
        total = sum(w[s] for s in sizes if s not in held)
        new = {s: 2 * sizes[s] for s in sizes if s not in held and w[s] * left / total > 2 * sizes[s]}
        if not new:
            return {**held, **{s: w[s] * left / total for s in sizes if s not in held}}
        held |= new


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["b", "a", "é", None, "Z"][int(rng.integers(0, 5) * rng.random())], " ".join(["w"] * int(rng.lognormal(3, 1)))) for i in range(800)]
    rows += [(1000, "a", None), (1001, "a", ""), (1002, "empty", "  "), (None, "a", "x y"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 for s in want), (taken, want)
    key = lambda rs: sorted((str(r["id"]), str(r["source"]), r["size"], r["copies"]) for r in rs)
    assert key(mixing.mix(df.repartition(7)).collect()) == key(got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([(1, 3, 10), (1, 8, 20), (1, 40, 2), (2, 5, 4)], "sid long, size long, n long")
    sources = spark.createDataFrame([(1, 270, 120.0), (2, 20, 30.0)], "sid long, source_size long, target double")
    for r in mixing.tilts(cells, sources).collect():
        own = [(c["size"], c["n"]) for c in cells.filter(F.col("sid") == r["sid"]).collect()]
        words = sum(n * s * min(2.0, np.exp(r["lam"] * s / r["mean"])) for s, n in own)
        assert abs(words - {1: 120.0, 2: 30.0}[r["sid"]]) < 1e-3


# --- media -----------------------------------------------------------------------------------
@pytest.mark.parametrize("compression", [media.NONE, media.PACKBITS, media.LZW, media.DEFLATE])
@pytest.mark.parametrize("tile", [None, 16, 48])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, tile, predictor):
    rng = np.random.default_rng(compression)
    pages = [rng.integers(0, 4, (h, w)).astype(np.uint8) for h, w in ((1, 64), (70, 64), (33, 5))]
    pages.append(np.zeros((1100, 64), np.uint8))
    pages.append(rng.integers(0, 256, (90, 64)).astype(np.uint8))
    got = list(media.read_tiff(media.write_tiff(pages, compression, predictor, tile)))
    assert len(got) == len(pages) and all((a == b).all() and a.shape == b.shape for a, b in zip(got, pages))


def test_long_lzw_resets_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 5000
    assert media.lzw_decode(media.lzw_encode(data), len(data)) == data
    assert media.packbits_decode(media.packbits_encode(data), len(data)) == data


def test_packbits_example():
    # the example of the public specification
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_media_of_texts(spark):
    given = ["", None, "a", "x" * 64, "é" * 400, "q" * 2000, "a"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(given)] + [(None, "a", "m")], "doc_id long, text string, media string")
    files = media.stored(df, page_rows=8)
    got = media.features(files).collect()
    assert len(got) == len(given) + 1
    for r in got:
        raw = ("a" if r["id"] is None else given[r["id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r for r in got if r["id"] in (2, 6, None)]
    assert len({tuple(x for k, x in r.asDict().items() if k != "id") for r in same}) == 1
    assert [r["page"] for r in media.pages(files.filter("id = 4")).orderBy("page").collect()] == [0, 1]
    assert media.features(media.stored(df.limit(0))).count() == 0


def test_query_meets_every_layout():
    assert {media.layout(str(i).encode()) for i in range(500)} == {(c, p, t) for c in (media.PACKBITS, media.LZW, media.DEFLATE) for p in (1, 2) for t in (None, 64, 32)}


def test_long_files_of_every_layout(spark):
    rng = random.Random(5)
    given = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(3000, 9000))) * rng.choice([1, 4]) for _ in range(60)]
    assert len({media.layout(t.encode()) for t in given}) == 18
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = media.features(media.stored(df, page_rows=100)).collect()
    assert sorted(r["id"] for r in got) == list(range(60))
    for r in got:
        raw = given[r["id"]].encode()
        payload = raw.ljust(-(-len(raw) // 64) * 64, b"\0")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"].split(":")[0] == str(-(-len(payload) // 6400))


def test_damaged_files_have_a_status(spark):
    whole = {c: media.write_tiff([np.arange(6400, dtype=np.uint8).reshape(100, 64)] * 2, c) for c in (media.NONE, media.PACKBITS, media.LZW, media.DEFLATE)}
    broken = [b"", b"II", b"text", b"II*\0" + b"\xff" * 4]
    for data in whole.values():
        broken += [data[:n] for n in range(8, len(data), 97)]
        broken += [data[:n] + bytes((data[n] ^ 255,)) + data[n + 1:] for n in (4, *range(len(data) - 130, len(data), 3))]
    files = spark.createDataFrame([(i, len(x), bytearray(x)) for i, x in enumerate(broken)] + [(-1, 0, bytearray(whole[media.LZW])), (-2, 0, None)], "id long, n_bytes long, media binary")
    rows = media.pages(files).collect()
    assert [(r["page"], r["status"]) for r in rows if r["id"] == -1] == [(0, "ok"), (1, "ok")]
    assert all((r["status"] == "ok") == (r["pixels"] is not None) for r in rows)
    assert {r["id"] for r in rows if r["status"] != "ok"} >= {0, 1, 2, 3} and -2 not in {r["id"] for r in rows}
    digests = {r["id"]: r for r in media.features(files).collect()}
    assert digests[-1]["payload_bytes"] == 12800 and digests[2]["feature"] is None and digests[2]["media_bytes"] == 4


# --- quality ---------------------------------------------------------------------------------
@tables
def test_quality_is_learned_and_generalises(spark):
    d = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    got = QUERIES["op8_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    right = got.filter(F.col("predicted") == F.col("quality")).count() / got.count()
    assert right >= 0.95
    docs = {r["doc_id"]: r["held_out"] for r in QUERIES["op8_quality"](spark, d).select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in docs.items())


def test_quality_of_odd_texts(spark):
    rows = [(i, ("good clean words here " * 5) if i % 2 else "BAD!!! ### $$$ BAD!!!" * 4) for i in range(40)]
    odd = [(100, None), (101, ""), (102, " \n"), (None, "good clean words"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 9.0) for i, t in rows + odd], "doc_id long, text string, score double").select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None)], "doc_id long, quality int")
    w = quality.fit(df, labels)
    got = quality.scored(df, w).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > 0.7 > 0.3 > by[2] and by[100] == by[101] == by[102]
    assert (quality.fit(df, labels) == w).all()
    none = quality.fit(df, labels.limit(0))
    assert not none.any() and quality.scored(df.limit(0), none).count() == 0


def test_quality_equals_a_plain_learner(spark):
    """Weights and scores against dictionaries and loops; equal texts score alike in every partitioning."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Good", "bad", "42"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40))), i % 2) for i in range(60)] + [(100, "", 1), (101, None, 0), (102, "w1", 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").withColumnRenamed("score", "label")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    weights = quality.fit(docs, labels)

    def vector(text):
        import pyarrow as pa

        places = quality._grams(pa.array([text], pa.string()))[0].tolist()
        return {k: np.float32(places.count(k) / len(places)) * quality.SCALE for k in set(places)} | {quality.FEATURES: 1.0}

    turn = {r["id"]: r["t"] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "id long").select("id", F.xxhash64("id", F.lit("order")).alias("t")).collect()}
    total: dict = {}
    shards = {turn[i] % quality.SHARDS for i, _, _ in rows}
    for shard in shards:
        z, n = {}, {}

        def weight(k):
            zk = z.get(k, 0.0)
            return 0.0 if abs(zk) <= quality.L1 else (math.copysign(quality.L1, zk) - zk) / ((quality.BETA + math.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)

        mine = sorted((turn[i], i, vector(t), y) for i, t, y in rows if turn[i] % quality.SHARDS == shard)
        for _ in range(quality.EPOCHS):
            for _, _, x, y in mine:
                p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
                for k, v in x.items():
                    g, w, old = (p - y) * v, weight(k), n.get(k, 0.0)
                    n[k] = old + g * g
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / quality.ALPHA * w
        for k in z:
            total[k] = total.get(k, 0.0) + weight(k) / len(shards)
    want = np.zeros(quality.FEATURES + 1)
    want[list(total)] = list(total.values())
    assert np.abs(weights - want).max() < 1e-5 and np.abs(want).max() > 0.01
    repeated = docs.select("doc_id", "text").crossJoin(spark.range(20).select(F.col("id").alias("copy")))
    got = [{(r["doc_id"], r["score"]) for r in quality.scored(repeated.repartition(n, "copy", "doc_id"), weights).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for i, s in got[0]:
        x = vector(dict((a, b) for a, b, _ in rows)[i])
        assert abs(s - 1 / (1 + math.exp(-sum(want[k] * v for k, v in x.items())))) < 1e-4

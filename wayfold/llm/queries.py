"""Queries of the operators, bound to the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrays import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_minhash(spark, d):
    from wayfold.llm.minhash import near_duplicates

    r = near_duplicates(table(spark, d, "documents"), size=2)
    return r.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: (verdict, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts whose pages make up the block list.
LISTED_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")


@query
def op3_url_filters(spark, d):
    from wayfold.llm.urls import canonical_urls, judge_urls

    pages = table(spark, d, "pages")
    listed = canonical_urls(pages.filter(F.lower("url").rlike("://([^/?#]*\\.)?(" + "|".join(LISTED_HOSTS) + ")\\.")))
    return judge_urls(pages, listed, URL_RULES).withColumnRenamed("id", "page_id")


def _fits(verdict: str, host: str, path: str) -> str:
    return f"((host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
ORACLES["op3_url_filters"] = f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM r),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || rtrim(path, '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical,
  CASE {' '.join(f"WHEN {_fits(*r)} THEN '{r[1] + r[2]}'" for r in _LONGEST)} END AS rule, CASE {' '.join(f"WHEN {_fits(*r)} THEN '{r[0]}'" for r in _LONGEST)} END AS says FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(lower(url), '://([^/?#]*\\.)?({'|'.join(LISTED_HOSTS)})\\.') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND l.canonical IS NOT NULL AS listed FROM c LEFT JOIN l ON c.canonical = l.canonical"""


@query
def op6_mixing(spark, d):
    from wayfold.llm.mixing import mix

    r = mix(table(spark, d, "documents"))
    return r.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


@query
def op5_media(spark, d):
    from wayfold.llm.media import features, stored

    return features(stored(table(spark, d, "documents"))).withColumnRenamed("id", "doc_id")


@query
def op8_quality(spark, d):
    from wayfold.llm.quality import fit, held_out, scored

    docs = table(spark, d, "documents")
    w = fit(docs, table(spark, d, "labels").filter(~held_out()))
    r = scored(docs.select("doc_id", "text"), w).select("doc_id", held_out().alias("held_out"), "score")
    return r.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op1_sentencepiece(spark, d):
    from wayfold.llm.pieces import encoded

    return encoded(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), F.size("ids").alias("n_pieces"), "ids", "round_trip")


@query
def op4_lines(spark, d):
    from wayfold.llm.lines import dedup_lines

    return dedup_lines(table(spark, d, "documents").select("doc_id", "text"))


@query
def op7_windows(spark, d):
    from wayfold.llm.windows import remove_repeats

    r = remove_repeats(table(spark, d, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_embeddings(spark, d):
    from wayfold.llm.embeddings import near_vectors

    r = near_vectors(table(spark, d, "embeddings"))
    return r.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "recall")


@query
def op9_suffixes(spark, d):
    from wayfold.llm.suffixes import remove_strings

    r = remove_strings(table(spark, d, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_codes(spark, d):
    from wayfold.llm.codes import compress, digest

    r, books = compress(table(spark, d, "embeddings"))
    return r.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Rows of ``embeddings`` that can be put on the integer grid, with their grid vector ``g``.
_GRID = "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS g FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_COORDINATES = [f"a{k}" for k in range(4)]


def _nearest(book: str) -> str:
    gap = " + ".join(f"(p.{a} - c.{a}) * (p.{a} - c.{a})" for a in _COORDINATES)
    return f"SELECT p.vec_id, p.part, arg_min(c.entry, ({gap}) * 64 + c.entry) AS entry, min({gap}) AS far FROM p JOIN {book} c ON p.part = c.part GROUP BY p.vec_id, p.part"


def _means(book: str, near: str) -> str:
    cols = ", ".join(f"coalesce(floor(m.{a} / m.n)::BIGINT, c.{a}) AS {a}" for a in _COORDINATES)
    sums = ", ".join(f"sum(p.{a})::DOUBLE AS {a}" for a in _COORDINATES)
    return f"SELECT c.part, c.entry, {cols} FROM {book} c LEFT JOIN (SELECT p.part, k.entry, count(*) AS n, {sums} FROM p JOIN {near} k ON p.vec_id = k.vec_id AND p.part = k.part GROUP BY p.part, k.entry) m ON c.part = m.part AND c.entry = m.entry"


ORACLES["op12_codes"] = f"""WITH v AS ({_GRID}), p AS MATERIALIZED (SELECT vec_id, part, {', '.join(f'g[4 * part + {k + 1}] AS a{k}' for k in range(4))} FROM v, range(16) AS r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
c0 AS MATERIALIZED (SELECT part, entry, a0, a1, a2, a3 FROM p JOIN first USING (vec_id)), k0 AS MATERIALIZED ({_nearest('c0')}),
c1 AS MATERIALIZED ({_means('c0', 'k0')}), k1 AS MATERIALIZED ({_nearest('c1')}), c2 AS MATERIALIZED ({_means('c1', 'k1')}), k2 AS MATERIALIZED ({_nearest('c2')}),
r AS MATERIALIZED (SELECT v.vec_id, v.label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM v JOIN k2 USING (vec_id) GROUP BY v.vec_id, v.label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', a0, a1, a2, a3), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM r"""


@query
def op13_negatives(spark, d):
    from wayfold.llm.negatives import hard_negatives

    e = table(spark, d, "embeddings")
    moved = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 50 == 0)


ORACLES["op13_negatives"] = f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, g FROM ({_GRID}) WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.g::DOUBLE[], o.g::DOUBLE[])::BIGINT AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


@query
def op11_neighbours(spark, d):
    from wayfold.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, d, "embeddings"), F.col("id") % 20 == 0)

"""Splits, subsets, resampling and mixing of documents."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import sampling as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

SPLIT = """gr AS (SELECT c AS grp, row_number() OVER (ORDER BY md5('split|' || c), c) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey * 1000 + c_custkey // 50 AS c FROM customer)),
rt AS (SELECT i, n * w / 100.0 AS target, floor(n * w / 100.0) AS base FROM (SELECT DISTINCT n FROM gr), (VALUES (1, 80.0::DOUBLE), (2, 10.0::DOUBLE), (3, 10.0::DOUBLE)) v(i, w)),
qt AS (SELECT i, base + CASE WHEN row_number() OVER (ORDER BY target - base DESC, i) <= (SELECT DISTINCT n FROM gr) - (SELECT sum(base) FROM rt) THEN 1 ELSE 0 END AS q FROM rt),
cu AS (SELECT i, sum(q) OVER (ORDER BY i) AS upto FROM qt),
sp AS (SELECT c_custkey, c_nationkey * 1000 + c_custkey // 50 AS grp, CASE WHEN k <= (SELECT upto FROM cu WHERE i = 1) THEN 'train' WHEN k <= (SELECT upto FROM cu WHERE i = 2) THEN 'eval' ELSE 'test' END AS split
  FROM customer JOIN gr ON gr.grp = c_nationkey * 1000 + c_custkey // 50)"""


def _customers(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey").cast("long") * 1000 + F.floor(F.col("c_custkey") / 50)).alias("grp"))


@query("split_by_group", ctes(SPLIT) + "SELECT c_custkey, grp, split FROM sp")
def _(spark, d):
    return op.split_by_group(_customers(spark, d), "grp", [80, 10, 10], ["train", "eval", "test"], "split").select("c_custkey", "grp", "split")


@query("split_report", ctes(SPLIT) + "SELECT split, count(DISTINCT grp) AS n_groups, count(*) AS n_samples FROM sp GROUP BY 1")
def _(spark, d):
    return op.split_report(op.split_by_group(_customers(spark, d), "grp", [80, 10, 10], ["train", "eval", "test"], "split"), "grp")


@query("sample_within_group", """WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('within|' || source || '|' || doc_id), source, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM k WHERE k <= greatest(1, least(n, round_even(n * 0.3, 0)))""")
def _(spark, d):
    return op.sample_within_group(t.table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 0.3, "within")


@query("mini_sample", "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY md5('mini|' || doc_id), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.1))")
def _(spark, d):
    return op.mini_sample(t.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 0.1, "mini")


@query("reweight_dataset", """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
dr AS (SELECT j AS draw, ('0x' || substr(md5('rw|' || j), 1, 12))::BIGINT % (SELECT count(*) FROM documents) AS i FROM (SELECT unnest(range(1, CAST(floor(count(*) * 1.5) AS BIGINT) + 1)) AS j FROM documents))
SELECT draw, doc_id FROM dr JOIN k USING (i)""")
def _(spark, d):
    return op.reweight_dataset(t.table(spark, d, "documents").select("doc_id"), "doc_id", weight=1.5, seed="rw").select("draw", "doc_id")


MIX = """a AS (SELECT 'english' AS s, 0.7::DOUBLE AS p, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT 'other', 0.3::DOUBLE, doc_id FROM documents WHERE lang <> 'en'),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) AS i, count(*) OVER (PARTITION BY s) AS n FROM a)"""


def _mix(name, sql):
    @query(name, ctes(MIX) + sql)
    def _(spark, d):
        docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
        parts = {"english": docs.filter("lang = 'en'").select("id"), "other": docs.filter("lang <> 'en'").select("id")}
        return op.mix_datasets(parts, "id", name.removeprefix("mix_"), [0.7, 0.3]).select("_dataset_name", "id", r6("mix_time").alias("mix_time"))


_mix("mix_interleave_once", f"SELECT s AS _dataset_name, id, {r('i / p')} AS mix_time FROM k")
_mix("mix_interleave_under", f"SELECT s AS _dataset_name, id, {r('i / p')} AS mix_time FROM k WHERE i / p <= (SELECT min(n / p) FROM k)")
_mix("mix_interleave_over", f""", z AS (SELECT *, (SELECT max(n / p) FROM k) AS stop FROM k), c AS (SELECT s, p, id, stop, i + n * unnest(range(0, CAST(ceil(stop * p / n) AS BIGINT))) AS i FROM z)
SELECT s AS _dataset_name, id, {r('i / p')} AS mix_time FROM c WHERE i / p <= stop""")


@query("mix_datasets", ctes(MIX) + "SELECT s AS _dataset_name, id FROM k")
def _(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return op.mix_datasets({"english": docs.filter("lang = 'en'").select("id"), "other": docs.filter("lang <> 'en'").select("id")}, "id")

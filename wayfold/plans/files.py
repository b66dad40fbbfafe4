"""Sources, sinks, streams and the registry, exercised by round trips through the scratch folder."""

import uuid

from pyspark.sql import functions as F

from wayfold import registry
from wayfold.functions.stats import r6
from wayfold.operators import graph as graph_op
from wayfold.plans.catalog import ctes, query, r
from wayfold.plans.evaluation import rounded
from wayfold.plans.graph import G, graph, transitions
from wayfold.plans.rewards import G as GROUP
from wayfold.session import scratch_path
from wayfold.sources import files as io, tables as t
from wayfold.streaming import incremental as inc


def fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def arrivals(df, table, key, batches):
    """Write ``df`` as a folder of arriving files: (folder, files per batch) for so many batches.

    There are two files a batch at least and as many as ``table`` has splits, so a file does not grow with the table.
    """
    src, each = fresh(df.sparkSession, "arrivals"), max(2, -(-table.rdd.getNumPartitions() // batches))
    df.repartition(batches * each, key).write.parquet(src)
    return src, each


@query("scan_rollout_jsonl", f"SELECT doc_id // 100 AS step, count(*) AS n, {r('avg(doc_id % 10)')} AS score, max(length(text)) AS longest FROM documents WHERE doc_id % 10 > 0 GROUP BY 1")
def _(spark, d):
    k, path = F.col("doc_id"), fresh(spark, "log")
    line = F.to_json(F.struct(F.col("text").alias("input"), F.col("lang").alias("output"), (k % 10).cast("double").alias("score")))
    broken = F.when(k % 20 == 0, F.concat(F.lit('{"input": '), "lang")).when(k % 10 == 0, "").otherwise(line)
    t.table(spark, d, "documents").select(F.floor(k / 100).alias("step"), broken.alias("value")).write.partitionBy("step").text(path)
    return rounded(io.scan_rollout_jsonl(spark, path).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.max(F.length("input")).cast("long").alias("longest")), "score")


@query("write_rollout_log", "SELECT doc_id // 100 AS step, text AS input, lang AS output, source AS gts FROM documents")
def _(spark, d):
    path = fresh(spark, "log")
    io.write_rollout_log(t.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("step"), F.col("text").alias("input"), F.col("lang").alias("output"), F.col("source").alias("gts")), path)
    return io.scan_rollout_jsonl(spark, path).select("step", "input", "output", "gts")


@query("scan_eval_dump", ctes(t.EPISODES_SQL) + "SELECT model, task, CAST(sample_id AS VARCHAR) AS sample_id, success, num_turns, finish_reason FROM episodes")
def _(spark, d):
    path = fresh(spark, "dump")
    e = t.episodes(spark, d).select("model", "task", F.col("sample_id").cast("string").alias("sample_id"), "success", "num_turns", "finish_reason", "cumulative_reward")
    e.write.partitionBy("model", "task").json(path)
    return io.scan_eval_dump(spark, path, layout=r"model=([^/]+)/task=([^/]+)/([^/]+)$", multi_line=False).select("model", "task", "sample_id", "success", "num_turns", "finish_reason")


@query("load_dataset_auto", """SELECT CASE WHEN lang = 'en' THEN 'a' WHEN lang = 'fr' THEN 'b' WHEN lang = 'de' THEN 'c' ELSE 'd' END AS _dataset_name, CASE WHEN lang IN ('en', 'fr', 'de') THEN doc_id END AS doc_id,
  CASE WHEN lang IN ('en', 'fr', 'de') THEN text END AS text, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN source END AS value FROM documents""")
def _(spark, d):
    path, docs = fresh(spark, "data"), t.table(spark, d, "documents")
    docs.filter("lang = 'en'").select("doc_id", "text").write.json(f"{path}/a.jsonl")
    docs.filter("lang = 'fr'").select("doc_id", "text").write.parquet(f"{path}/b.parquet")
    docs.filter("lang = 'de'").select("doc_id", "text").write.option("header", "true").option("escape", '"').csv(f"{path}/c.csv")
    docs.filter("lang NOT IN ('en', 'fr', 'de')").select(F.col("source").alias("value")).write.text(f"{path}/d.txt")
    src = {n: f"{path}/{f}" for n, f in (("a", "a.jsonl"), ("b", "b.parquet"), ("c", "c.csv"), ("d", "d.txt"))}
    return io.load_dataset_auto(spark, src, {"a": "doc_id long, text string", "c": "doc_id long, text string"}, multi_line=True).select("_dataset_name", "doc_id", "text", "value")


@query("write_sft_datasets", """SELECT lang AS dataset, lang || '.jsonl' AS file_name, CASE WHEN lang = 'de' THEN 'alpaca' ELSE 'sharegpt' END AS formatting, CASE WHEN lang <> 'de' THEN 'messages' END AS messages, count(*) AS n_records FROM documents GROUP BY ALL""")
def _(spark, d):
    docs, sets = t.table(spark, d, "documents"), {}
    for lang in ("en", "fr", "es", "de", "none"):
        part = docs.filter(F.col("lang") == lang)
        conv = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
        sets[lang] = part.select(F.col("source").alias("instruction"), F.col("text").alias("output")) if lang == "de" else part.select(conv.alias("messages"))
    return io.write_sft_datasets(sets, fresh(spark, "sft"))


@query("graph_tables_io", ctes(*G) + "SELECT src, dst, action, n_actions FROM eraw QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n_actions, CASE WHEN turn < 20 THEN 0 ELSE 1 END, traj_id, turn, action) = 1")
def _(spark, d):
    from wayfold.session import materialize
    path, tr = fresh(spark, "graph"), materialize(transitions(spark, d))
    for part in (tr.filter("turn < 20"), tr.filter("turn >= 20")):
        io.save_graph(graph_op.dedup_nodes_exact(part), graph_op.edges_shorter_wins(graph_op.raw_edges(part)), path)
    return io.load_graph(spark, path)[1].select("src", "dst", "action", "n_actions")


ITEMS = """it AS (SELECT 'docs' AS source, source AS scene_id, lang || (doc_id % 9) AS sample_id, source || '/s' || lang || (doc_id % 9) AS sample_dir FROM documents
UNION ALL SELECT 'labels', source, lang || (doc_id % 9), source || '/s' || lang || (doc_id % 9) FROM documents JOIN labels USING (doc_id)),
mf AS (SELECT scene_id, sample_dir, min(sample_id) AS sample_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM it GROUP BY ALL)"""


def _items(spark, d):
    docs = t.table(spark, d, "documents")
    sid = F.concat("lang", (F.col("doc_id") % 9).cast("string"))
    cols = [F.col("source").alias("scene_id"), sid.alias("sample_id"), F.array(F.concat("source", F.lit("/s"), sid, F.lit("/0.png"))).alias("image_path")]
    a = docs.select(F.lit("docs").alias("source"), *cols)
    b = docs.join(t.table(spark, d, "labels"), "doc_id").select(F.lit("labels").alias("source"), *cols)
    return a.unionByName(b)


@query("build_manifest", ctes(ITEMS) + "SELECT *, count(*) OVER (PARTITION BY scene_id) AS scene_samples FROM mf")
def _(spark, d):
    return io.build_manifest(_items(spark, d))


@query("manifest_top_scenes", ctes(ITEMS) + "SELECT scene_id, count(*) AS n FROM mf GROUP BY 1 ORDER BY n DESC, scene_id LIMIT 5")
def _(spark, d):
    return io.top_scenes(io.build_manifest(_items(spark, d)))


@query("expand_env_specs", """WITH sp AS (SELECT s_suppkey AS k, 'env' || (s_suppkey % 3) AS name, 1 + s_suppkey % 5 AS n FROM supplier),
dr AS (SELECT k AS spec_id, name, i, ('0x' || substr(md5('7|' || k || '|' || name || '|' || i), 1, 12))::BIGINT AS h FROM sp, range(1, 6) x(i) WHERE i <= n),
cp AS (SELECT k AS spec_id, name, i, k + list_reduce([i - 1] || range(1, 33), lambda x, q: CASE WHEN ('0x' || substr(md5('7|' || k || '|' || name || '|' || q || '|' || greatest(x, (('0x' || substr(md5('7|' || k || '|' || name || '|' || q), 1, 12))::BIGINT % 10 - x + 10) % 10)), 1, 12))::BIGINT % 2 = 1
  THEN (('0x' || substr(md5('7|' || k || '|' || name || '|' || q), 1, 12))::BIGINT % 10 - x + 10) % 10 ELSE x END) % 5 AS v FROM sp, range(1, 6) x(i) WHERE i <= n AND k % 4 = 2)
SELECT spec_id, name, i, h % 2147483648 AS env_seed FROM dr WHERE spec_id % 4 = 0 UNION ALL SELECT spec_id, name, i, spec_id + h % 10 FROM dr WHERE spec_id % 4 = 1
UNION ALL SELECT spec_id, name, i, v FROM cp UNION ALL SELECT spec_id, name, i, spec_id * 10 + i FROM dr WHERE spec_id % 4 = 3""")
def _(spark, d):
    k = F.col("s_suppkey")
    kind = k % 4
    seed = F.when(kind == 0, F.array(k)).when(kind == 1, F.array(k, k + 9)).when(kind == 2, F.array(k, k + 4, F.lit(2).cast("long")))
    lst = F.when(kind == 3, F.transform(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")), lambda i: k * 10 + i))
    specs = t.table(spark, d, "supplier").select(k.alias("spec_id"), F.concat(F.lit("env"), (k % 3).cast("string")).alias("name"), (1 + k % 5).alias("n_envs"), seed.alias("seed"), lst.alias("seed_list"))
    return io.expand_env_specs(specs, 7).select("spec_id", "name", F.col("i").cast("long").alias("i"), "env_seed")


# --- streams -------------------------------------------------------------------------------
@query("stream_rollout_summary", ctes(t.EPISODES_SQL) + " UNION ALL ".join(f"""SELECT {tag} AS tag, count(*) AS n_episodes, {r('avg(CAST(success AS INT))')} AS success_rate, {r('avg(cumulative_reward)')} AS avg_reward,
  {r('avg(num_turns)')} AS avg_turns, count(*) FILTER (WHERE finish_reason = 'error') AS n_errors FROM episodes {g}""" for tag, g in (("'all'", ""), ("task", "GROUP BY task"))))
def _(spark, d):
    e = t.episodes(spark, d).select("task", "sample_id", "success", "cumulative_reward", "num_turns", "finish_reason")
    src, each = arrivals(e, t.table(spark, d, "orders"), "sample_id", 2)
    return rounded(inc.stream_rollout_summary(spark, src, e.schema.toDDL(), fresh(spark, "summary"), each), "success_rate", "avg_reward", "avg_turns")


@query("stream_graph_upsert", ctes(*G) + "SELECT src, dst, min(n_actions) AS n_actions FROM eraw GROUP BY ALL")
def _(spark, d):
    s = t.steps(spark, d)
    src, each = arrivals(s, t.table(spark, d, "events"), "turn", 3)  # every episode is spread over the batches
    return inc.stream_graph_upsert(spark, src, s.schema.toDDL(), fresh(spark, "graph"), each)[1].select("src", "dst", "n_actions")


@query("stream_dataset_append", r"""SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS n_tokens FROM documents
WHERE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) <= 150""")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    src, each = arrivals(docs, docs, "doc_id", 2)
    return inc.stream_dataset_append(spark, src, docs.schema.toDDL(), fresh(spark, "prompts"), "text", 150, each).select("doc_id", "n_tokens")


# --- registry ------------------------------------------------------------------------------
@query("registry", ctes(t.SAMPLES_SQL, GROUP, "o AS (SELECT uid, sum(length * reward) / sum(length) AS base FROM samples GROUP BY uid)") + " UNION ALL ".join(
    f"SELECT '{n}' AS estimator, uid, sample_id, {r(x)} AS advantage FROM samples JOIN g USING (uid) JOIN o USING (uid)" for n, x in (
        ("grpo", "CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - mu) / (sd + 1e-6) END"), ("opo", "reward - CASE WHEN n = 1 THEN 0 ELSE base END"), ("rloo", "CASE WHEN n = 1 THEN 0 ELSE n / (n - 1) * (reward - mu) END"))))
def _(spark, d):
    s, out = t.samples(spark, d), None
    for n in ("grpo", "opo", "rloo"):
        part = registry.get("advantage", n)(s).select(F.lit(n).alias("estimator"), "uid", "sample_id", r6("advantage").alias("advantage"))
        out = part if out is None else out.unionByName(part)
    return out


@query("custom_scorer", f"SELECT doc_id, {r('length(text) / n_chars')} AS score FROM documents")
def _(spark, d):
    registry.register("scorer", "fullness")(_fullness)
    return t.table(spark, d, "documents").select("doc_id", r6(registry.get("scorer", "fullness")("text", "n_chars")).alias("score"))


def _fullness(text: str, n: str):
    """Characters held of those counted; a count of zero divides as doubles do, to infinity or NaN, like the SQL."""
    size, n = F.length(text), F.col(n)
    by_zero = F.when(size > 0, float("inf")).when(size == 0, float("nan"))
    return F.when(n == 0, by_zero).otherwise(size / n)

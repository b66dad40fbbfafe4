"""Readers and writers for logs, dumps, datasets and stored graphs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.ordering import hash_int, hash_of

ROLLOUT_SCHEMA = "input string, output string, gts string, score double, step long, reward_scores map<string,double>, _corrupt string"
EPISODE_SCHEMA = ("rewards array<double>, infos array<map<string,string>>, success boolean, cumulative_reward double, num_turns long, finish_reason string, "
                  "terminated boolean, seed long, tag_id string, env_name string, sample_id string, _corrupt string")
# Path layouts of step logs and of evaluation dumps.
STEP_PATH = r"(?:step=|/)(\d+)(?:/[^/]*|\.jsonl)$"
DUMP_PATH = r"([^/]+)/tag_([^/]+)/([^/]+)/metrics\.json$"


def scan_rollout_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rollout lines with their step (from the file name) and line number; blank and malformed lines are skipped.

    Lines are numbered per file block, so one large file is still read by many tasks.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_o"))
    # ids rise by one within a block, so its first id and the lines of the blocks before give the number
    per = raw.groupBy("file", "block").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of one file
    per = per.select("file", "block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    raw = raw.join(per, ["file", "block"]).withColumn("line", F.col("_o") - F.col("_first") + F.col("_before"))
    j = raw.select("file", "line", F.regexp_extract("file", STEP_PATH, 1).try_cast("long").alias("file_step"), "value",
                   F.from_json("value", ROLLOUT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    j = j.filter((F.trim("value") != "") & F.col("j._corrupt").isNull() & F.col("j").isNotNull())
    return j.select("file", F.coalesce("file_step", "j.step").alias("step"), "line", "j.input", "j.output", "j.gts", "j.score", "j.reward_scores")


def write_rollout_log(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines per step."""
    rows.write.mode("append").partitionBy("step").json(path)


def scan_eval_dump(spark: SparkSession, path: str, layout: str = DUMP_PATH, multi_line: bool = True) -> DataFrame:
    """Episode metrics below ``path``; model, task and rollout come from the file path, corrupt files are left out."""
    r = spark.read.schema(EPISODE_SCHEMA).option("recursiveFileLookup", "true").option("multiLine", str(multi_line).lower()).option("columnNameOfCorruptRecord", "_corrupt")
    e = r.json(path).withColumn("_f", F.col("_metadata.file_path")).filter(F.col("_f").rlike(layout) & F.col("_corrupt").isNull())
    return e.select(F.regexp_extract("_f", layout, 1).alias("model"), F.regexp_extract("_f", layout, 2).alias("task"), F.regexp_extract("_f", layout, 3).alias("rollout_id"), *[c for c in e.columns if not c.startswith("_")])


def load_dataset_auto(spark: SparkSession, sources: dict[str, str], schemas: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Union of named files, each read by its extension and tagged with its name.

    CSV values that hold line ends need ``multi_line``, which makes each file one task.
    """
    readers = {"csv": ("csv", {"header": "true", "multiLine": str(multi_line).lower(), "escape": '"'}), "json": ("json", {"multiLine": "true"}), "jsonl": ("json", {}), "parquet": ("parquet", {}), "txt": ("text", {}), "text": ("text", {})}
    frames = []
    for name, path in sources.items():
        ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if ext not in readers:
            raise ValueError(f"cannot tell the format of {path}")
        fmt, options = readers[ext]
        reader = spark.read.format(fmt).options(**options)
        if schemas and name in schemas and fmt != "parquet":
            reader = reader.schema(schemas[name])
        frames.append(reader.load(path).withColumn("_dataset_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_sft_datasets(datasets: dict[str, DataFrame], path: str, overrides: dict[str, dict] | None = None) -> DataFrame:
    """One folder of JSON lines per dataset and a manifest; empty datasets are skipped, none at all is an error.

    The manifest is one JSON object, ``dataset_info``: per dataset the file name, the formatting
    and the message column, over which an override's keys win.  Returns the same as rows.
    """
    spark = next(iter(datasets.values())).sparkSession
    rows, info = [], {}
    for name, df in datasets.items():
        if df.isEmpty():
            continue
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{name}.jsonl")
        talk = next((c for c in ("conversations", "messages") if c in df.columns), None)
        entry = {"file_name": f"{name}.jsonl", "formatting": "sharegpt", "columns": {"messages": talk}} if talk else {"file_name": f"{name}.jsonl", "formatting": "alpaca"}
        info[name] = entry = {**entry, **(overrides or {}).get(name, {})}
        rows.append((name, entry["file_name"], entry["formatting"], entry.get("columns", {}).get("messages"), seen.get["n"]))
    if not rows:
        raise ValueError("no dataset has any record")
    spark.createDataFrame([(json.dumps(info, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/dataset_info")
    return spark.createDataFrame(rows, "dataset string, file_name string, formatting string, messages string, n_records long")


def _stored(spark: SparkSession, path: str, below: int | None = None) -> tuple[DataFrame, DataFrame, int] | None:
    """Newest stored version of a graph (older than ``below``), or None."""
    from pyspark.errors import AnalysisException

    try:
        v = spark.read.parquet(f"{path}/edges").select("version")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the latter: only empty versions
            raise
        return None
    top = (v if below is None else v.filter(F.col("version") < below)).agg(F.max("version")).first()[0]
    if top is None:
        return None

    def part(name):
        return spark.read.parquet(f"{path}/{name}").filter(F.col("version") == top).drop("version")
    return part("nodes"), part("edges"), top


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the newest version; an old ``text`` label column is read as ``action``."""
    found = _stored(spark, path)
    if found is None:
        raise FileNotFoundError(f"no graph stored at {path}")
    nodes, edges, _ = found
    if "action" not in edges.columns and "text" in edges.columns:
        edges = edges.withColumnRenamed("text", "action")
    return nodes, edges


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int | None = None) -> None:
    """Merge with what is stored (stored attributes win, edge policy re-applied) and write a new version.

    A version is written whole to its own partition, so a repeated or failed write of the
    same version leaves the others untouched.
    """
    from wayfold.operators.graph import merge_graphs

    spark = nodes.sparkSession
    old = _stored(spark, path, version)
    if old is not None:
        nodes, edges = merge_graphs((old[0], old[1]), (nodes, edges))
    v = version if version is not None else (old[2] + 1 if old else 0)
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("version", F.lit(v)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/{name}")


def build_manifest(items: DataFrame) -> DataFrame:
    """Distinct (scene, sample folder) of items ``(source, scene_id, sample_id, image_path)`` with sorted source tags and the scene's sample count."""
    folder = F.regexp_replace(F.get("image_path", F.lit(0)), r"/[^/]*$", "")
    m = items.withColumn("sample_dir", folder).groupBy("scene_id", "sample_dir").agg(F.min("sample_id").alias("sample_id"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    n = m.groupBy("scene_id").agg(F.count(F.lit(1)).alias("scene_samples"))
    return m.join(n, "scene_id")


def top_scenes(manifest: DataFrame, k: int = 5) -> DataFrame:
    return manifest.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "scene_id").limit(k)


ROUNDS = 32  # of the swap-or-not permutation


def permuted(slot: Column, n: Column, seed: Column) -> Column:
    """Image of ``slot`` under a keyed permutation of 0 .. n - 1 (swap-or-not shuffle).

    Each round pairs every slot with its mirror at a keyed offset and swaps the two if the pair's
    keyed bit says so.  Any n will do, and one image costs the same whatever n.
    """
    def number(*parts):
        return hash_int(F.md5(F.concat_ws("|", seed, *[p.cast("string") for p in parts])))

    def swap(x, r):
        other = (number(r) % n - x + n) % n
        return F.when(number(r, F.greatest(x, other)) % 2 == 1, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), slot.cast("long"), swap)


def expand_env_specs(specs: DataFrame, base_seed: int) -> DataFrame:
    """n_envs rows per spec ``(spec_id, name, n_envs, seed, seed_list)`` with reproducible seeds.

    An explicit list is cut to n_envs and must be longer; one number draws from the full
    range, two from a closed range, three cap how often a value may occur: the i-th draw is then
    the i-th image of a keyed permutation of all (value, copy) slots, of which none is written out.
    """
    def fail(why):
        return F.raise_error(F.concat(F.lit(why + " in spec "), F.col("spec_id").cast("string"))).cast("boolean")
    size = F.size(F.coalesce("seed", F.array(F.lit(0).cast("long"))))
    lo, hi, cap = F.get("seed", F.lit(0)), F.get("seed", F.lit(1)), F.get("seed", F.lit(2))
    s = specs.withColumn("_n", size).filter(
        F.when(F.col("seed_list").isNotNull() & (F.size("seed_list") <= F.col("n_envs")), fail("seed list too short"))
        .when((F.col("_n") >= 2) & (hi < lo), fail("empty seed range")).when((F.col("_n") == 3) & ((cap <= 0) | ((hi - lo + 1) * cap < F.col("n_envs"))), fail("too few seeds")).otherwise(True))
    ids = ["spec_id", "name"]
    listed = s.filter("seed_list IS NOT NULL").select(*ids, F.posexplode(F.slice("seed_list", F.lit(1), F.col("n_envs").cast("int"))).alias("i", "env_seed")).withColumn("i", F.col("i") + 1)
    drawn = s.filter("seed_list IS NULL").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_envs").cast("int"))))
    h = hash_int(hash_of(str(base_seed), *ids, "i"))
    slot = permuted(F.col("i") - 1, (hi - lo + 1) * cap, F.concat_ws("|", F.lit(str(base_seed)), *[F.col(c).cast("string") for c in ids]))
    drawn = drawn.select(*ids, "i", F.when(F.col("_n") == 1, h % 2147483648).when(F.col("_n") == 2, lo + h % (hi - lo + 1)).otherwise(lo + slot % (hi - lo + 1)).alias("env_seed"))
    return listed.unionByName(drawn)

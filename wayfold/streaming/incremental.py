"""Incremental processing with Structured Streaming over growing log folders.

State lives in versioned tables written by ``foreachBatch``; the batch id is the version, so a
replayed batch overwrites its own result and nothing is applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import evaluation, graph
from wayfold.operators.batches import filter_overlong
from wayfold.session import materialize
from wayfold.sources import files


def _run(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
    q.awaitTermination()


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(n: int) -> list[tuple[int, int]]:
    """Batches 0 .. n - 1 as (first, last) runs whose lengths are the powers of two in n, longest first."""
    out, start = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out.append((start, start + (1 << bit) - 1))
            start += 1 << bit
    return out


def stream_rollout_summary(spark: SparkSession, source: str, schema: str, target: str, files_per_batch: int = 2) -> DataFrame:
    """Per-task and overall summary, refreshed with every arriving file of episodes; repeats of a sample count once.

    Two tables are kept.  ``sums`` has a version a batch, of which the last two stay.  ``seen`` holds
    every sample id once, in one folder for each run of batches; runs double in length like the
    digits of a binary counter, so n batches leave about log n folders and an id is written again
    about log n times.  A batch reads what the batch before it left and nothing of its own, so a
    replayed batch changes nothing.
    """
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def fold(df: DataFrame, batch: int) -> None:
        s = df.sparkSession
        at = lambda run: f"{target}/seen/{run[0]}-{run[1]}"
        before, now = runs(batch), runs(batch + 1)
        kind = df.schema["sample_id"].dataType.simpleString()
        rest = [c for c in df.columns if c != "sample_id"]
        new = df.groupBy("sample_id").agg(F.min(F.struct(*rest)).alias("w")).select("sample_id", "w.*")
        if before:
            known = s.read.schema(f"_known {kind}").parquet(*[at(r) for r in before])
            new = new.join(known, F.col("sample_id").eqNullSafe(F.col("_known")), "left_anti")
        new = materialize(new)
        merged = [r for r in before if r not in now]
        ids = new.select(F.col("sample_id").alias("_known"))
        if merged:
            ids = ids.unionByName(s.read.schema(f"_known {kind}").parquet(*[at(r) for r in merged]))
        ids.write.mode("overwrite").parquet(at(now[-1]))
        sums = new.select("task", F.lit(1).cast("long").alias("n"), F.col("success").cast("long").alias("s"), F.col("cumulative_reward").cast("double").alias("r"),
                          F.col("num_turns").cast("long").alias("t"), (F.col("finish_reason") == "error").cast("long").alias("e"))
        if batch:
            sums = sums.unionByName(s.read.schema(sums.schema).parquet(f"{target}/sums/{batch - 1}"))
        sums.groupBy("task").agg(*[F.sum(c).alias(c) for c in ("n", "s", "r", "t", "e")]).coalesce(1).write.mode("overwrite").parquet(f"{target}/sums/{batch}")
        for old in set(runs(batch - 1) if batch > 1 else []) - set(before) - set(now):
            _delete(s, at(old))
        _delete(s, f"{target}/sums/{batch - 2}")
    _run(e, fold, f"{target}/_checkpoint")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/sums")
    kept = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)  # two folders at most
    newest = max(int(f.getPath().getName()) for f in kept)
    g = spark.read.parquet(f"{target}/sums/{newest}").groupingSets([[], [F.col("task")]], "task").agg(F.grouping_id().alias("_all"), *[F.sum(c).alias(c) for c in ("n", "s", "r", "t", "e")])
    return g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("task")).alias("tag"), F.col("n").alias("n_episodes"), (F.col("s") / F.col("n")).alias("success_rate"), (F.col("r") / F.col("n")).alias("avg_reward"),
                    (F.col("t") / F.col("n")).alias("avg_turns"), F.col("e").alias("n_errors"))


def with_border(steps: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(steps to extract from, steps to carry): a batch and what earlier ones left at the borders of their runs.

    A step is carried while its next or previous turn has not come (``followed`` and ``led`` say
    which has), so two for each run of turns, and files of an episode may arrive in any order.  A
    turn sent again counts once; one from inside a run is carried again, which changes nothing.
    """
    key = ["traj_id", "turn"]
    new = steps.withColumn("followed", F.lit(False)).withColumn("led", F.col("turn") == 0)
    if carried is not None:
        new = new.unionByName(carried.join(steps.select("traj_id").distinct(), "traj_id", "left_semi"))
    mine = materialize(new.groupBy(*key).agg(*[F.first(c).alias(c) for c in steps.columns if c not in key], F.max("followed").alias("followed"), F.max("led").alias("led")))
    turns = mine.select(*key)
    after, before = [turns.withColumn("turn", F.col("turn") + by).withColumn(name, F.lit(True)) for by, name in ((-1, "_after"), (1, "_before"))]
    border = mine.join(after, key, "left").join(before, key, "left").withColumn("followed", F.col("followed") | F.col("_after").isNotNull()).withColumn("led", F.col("led") | F.col("_before").isNotNull())
    border = border.filter("NOT (followed AND led)").drop("_after", "_before")
    if carried is not None:
        border = border.unionByName(carried.join(turns.select("traj_id").distinct(), "traj_id", "left_anti"))
    return mine.select(*steps.columns), border


def stream_graph_upsert(spark: SparkSession, source: str, schema: str, target: str, files_per_batch: int = 2) -> tuple[DataFrame, DataFrame]:
    """Merge each arriving batch of steps into the stored graph and return the final graph.

    An episode may be split over batches: steps at the borders are kept in a table of their own,
    a version a batch, of which the last two stay, so a replayed batch reads what it read before.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(df: DataFrame, batch: int) -> None:
        place = f"{target}/_border/version="
        carried = df.sparkSession.read.schema(f"{schema}, followed boolean, led boolean").parquet(f"{place}{batch - 1}") if batch else None
        steps, border = with_border(df, carried)
        border.write.mode("overwrite").parquet(f"{place}{batch}")
        tr = graph.extract_transitions(steps)
        files.save_graph(graph.dedup_nodes_exact(tr), graph.edges_shorter_wins(graph.raw_edges(tr)), target, version=batch)
        _delete(spark, f"{place}{batch - 2}")
    _run(s, merge, f"{target}/_checkpoint")
    return files.load_graph(spark, target)


def stream_dataset_append(spark: SparkSession, source: str, schema: str, target: str, text: str, max_tokens: int, files_per_batch: int = 2) -> DataFrame:
    """Append each arriving batch of prompts after the overlong filter; one folder per batch keeps replays exact."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    _run(s, lambda df, batch: filter_overlong(df, text, max_tokens).write.mode("overwrite").parquet(f"{target}/data/batch={batch}"), f"{target}/_checkpoint")
    return spark.read.parquet(f"{target}/data")

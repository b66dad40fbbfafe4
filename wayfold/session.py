"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # skewed sides are split even where that costs one more shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # a side is broadcast by its measured size: files of few values shrink a hundredfold, and ``explode`` is not
    # estimated at all, so before a shuffle only tiny files count as small
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}

_local_scratch: str | None = None
_run = f"wayfold-{uuid.uuid4().hex}"


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive execution settings the operators rely on."""
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wayfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in this process's part of the scratch folder, which ``clear_scratch`` deletes."""
    return f"{scratch_dir(spark)}/{_run}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage of iterative jobs, survives lost executors, fixes non-deterministic
    columns, and gives the optimizer the real size of the intermediate result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over all shuffle partitions before an expression that multiplies them.

    Adaptive execution would merge a small input into few tasks although its output is large.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this process's intermediate tables; call it once the results are written or collected."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "").rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings that bound what the driver holds."""

from pyspark.sql import functions as F

from wayfold.session import materialize


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """Few distinct values: some hundred kB of parquet, over ten MB of rows once exploded."""
    df = materialize(spark.range(400_000).select((F.col("id") % 7).alias("k"), F.floor(F.col("id") / 40).alias("v"), F.lit("x" * 60).alias("s")))
    few = materialize(spark.range(7).select(F.col("id").alias("k"), F.lit("few").alias("name")).coalesce(1))
    wide = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3))))

    def final(j):
        j.write.format("noop").mode("overwrite").save()
        return j._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in final(df.select("k", "v", "s").join(wide, ["k", "v", "s"]))
    assert "BroadcastHashJoin" in final(df.join(few, "k"))

"""Documents to training tokens in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``.  Rows without ``doc_id`` pass the stages that need
one unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrays import broadcast_if_small, table
from wayfold.llm.lines import dedup_lines
from wayfold.llm.minhash import near_duplicates
from wayfold.llm.mixing import mix
from wayfold.llm.pieces import encoded
from wayfold.llm.quality import fit, held_out, scored
from wayfold.session import materialize

#: Least probability of good quality with which a document stays.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out fifth."""
    weights = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return scored(docs, weights, name="_score").filter(F.col("_score") >= LEAST_SCORE).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; a document stays even if no line is left."""
    r = dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return r.select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, by five-word shingles at 0.8."""
    r = materialize(near_duplicates(docs, size=5).filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct())
    return docs.join(broadcast_if_small(r, r.count()), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    copies = mix(docs).filter("id IS NOT NULL").groupBy(F.col("id").alias("doc_id")).agg(F.max("copies").alias("_copies"))
    r = docs.join(copies, "doc_id", "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.coalesce("_copies", F.lit(1)))))
    return r.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and copy, and whether decoding gives its text back."""
    return encoded(docs).select(F.col("id").alias("doc_id"), F.size("ids").alias("n_pieces"), "ids", "round_trip")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicate), ("mixture", mixture), ("tokens", tokens)]

#: The classifier's training and the rounding of rates can't be written as SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

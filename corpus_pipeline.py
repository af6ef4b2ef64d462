"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and is
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.llm import decontamination, minhash, packing, quality_rules, secret_scan
from planewright.llm.common import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio.

    Null, empty and short texts go; texts of any length are judged whole; repeated rows stay or go
    alike; an empty table stays empty; further columns, whatever their names, are passed on.
    """
    ratios = quality_rules.log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept(docs, ratios)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Texts without words are no one's duplicate and stay; of rows that share the id and the group one
    stays; rows without an id are a document each; long texts are compared whole; an empty table
    stays empty; further columns are passed on.
    """
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs.

    Texts without words stay; long texts are searched whole; repeated rows stay or go alike; an
    empty table stays empty, and an empty benchmark takes nothing; further columns are passed on.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text.

    Null and empty texts stay as they are; overlapping secrets are one mark; repeated rows are
    treated alike; an empty table stays empty; further columns are passed on.
    """
    columns = docs.columns
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    masked = secret_scan.masked(secret_scan.with_secrets(docs, ratios))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids from all documents left.

    A null or empty text is its end id alone; repeated rows are packed each; of long texts whole
    windows come first; an empty table gives no rows; further columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages train models and draw on a tokenizer, which SQL can't state; tests hold them against brute force.
ORACLE_SQL = None

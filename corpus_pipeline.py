"""The training-data pipeline: documents in, token ids out.

Each stage takes the session, the documents that its predecessor kept and the folder of
the input tables. The result of each is written as Parquet to the shared folder and read
again as the next one's documents, so no stage runs twice and the loss of an executor
costs at most the running stage. What a stage read is removed once its result is written;
the last result stays, as the returned rows are read from it.

The near-duplicate stage takes five words and a similarity of 0.8 or more: its fingerprints
are longer than those of the operator's query, which its contract fixes at three words and
two of 64 bits.

Defined cases are those of the operators; every stage but the last returns the columns of
its documents, whatever further ones there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from streetloom.llm import bpe, exact_dedup, mixing, quality, simhash
from streetloom.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    return bpe.encoded(docs)


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: The classifier is trained, so SQL cannot express the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if n:
            _remove(spark, f"{folder}/{n - 1}")
    return docs

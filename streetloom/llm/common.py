"""What the corpus operators share: tables, checkpoints, ordered blocks, components."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import star_components as components
from ..operators.order import checkpoint, shared_folder

__all__ = ["BATCH_ROWS", "SPACE", "WORD", "block_offsets", "checkpoint", "components", "n_words", "ordered_blocks", "packed", "row_hash", "shared_folder", "ship", "spread_join", "table", "text_of", "unpacked"]

#: The six characters that count as white space in every contract.
SPACE = r"[\x20\x09-\x0D]"
#: Everything else makes words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts can be long, so batches are short.
BATCH_ROWS = 256
#: Copies of a fact that many rows may look for.
SALTS = 16
#: Rows of an ordered block, about, and the least number of blocks.
BLOCK_ROWS = 200_000
MIN_BLOCKS = 16

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that any Spark reader can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers and keep their batches short.

    On a cluster the workers need not have the package installed: the driver
    zips the sources once per application and Spark distributes the archive.
    Batches are shortened for the session, as Spark has no such setting for a
    plan alone; shorter ones that the user has set stay.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="streetloom-"), "streetloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "streetloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def text_of(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame, **computed: Column) -> DataFrame:
    """The rows as one column (`row`) and computed columns beside it, so that no name clashes with theirs."""
    row = F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in docs.columns))
    return docs.select(row.alias("row"), *(column.alias(name) for name, column in computed.items()))


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows as they were before `packed`."""
    return rows.select("row.*")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash of their own, by their JSON."""
    columns = [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]
    return F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)))


def n_words(text: Column) -> Column:
    """Number of words, counted as word starts without building an array."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Left join of rows with facts of at most one row a key, however many rows share a key.

    Rows are dealt by their number (`uid`) over `salts` copies of each fact, so a key with
    a third of all rows lands in that many tasks; the copies are narrow, and callers leave
    out the facts of keys that a single row has.
    """
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod("uid", F.lit(salts)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")


def ordered_blocks(df: DataFrame, order: list[Column], blocks: int | None = None) -> DataFrame:
    """Range-partition by `order` into blocks numbered in that order (`_block`), and checkpoint.

    Equal keys share a block, so distinct sort keys bound each block; the number of blocks
    grows with the rows. It is written with them: later reads see the same cut, also after
    the loss of an executor. The rows are written once before, as sampling reads them too.
    """
    rows = checkpoint(df)
    if blocks is None:
        blocks = max(MIN_BLOCKS, rows.count() // BLOCK_ROWS + 1)
    return checkpoint(rows.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))


def block_offsets(blocked: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """For each group and block, the sum of `value` over the group's earlier blocks (`_before`)."""
    sums = blocked.groupBy(*groups, "_block").agg(F.sum(value).alias("_sum"))
    # one row a block in each group: at most as many as there are blocks
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")

"""Exact deduplication of texts by skew-safe combining, in DataFrame operations only.

Equal texts are those that are identical without their white space. Every combining
stage groups by digest AND content, so a digest alone never decides:

1. local: the map side of the first aggregation keeps one row for each content of a
   task, however many copies it read;
2. salted: copies meet under (salt, digest, content), the salt being the reading
   task's number modulo `salts`; a group of copies with a third of all rows is dealt
   over that many reducers, of one row a task each;
3. global: the at most `salts` winners of each content meet.

Every row then finds its group by the digest, a hot one in as many tasks as there are salts.

The winner is held as one decimal, code points first and then the inverted id, so the
aggregation stays a hash aggregation with fixed-width buffers.

Defined cases: a null text counts as empty, and empty and all-blank texts are equal
to each other; a null doc_id ranks after every other id; of fully repeated rows
exactly one is kept; an empty table gives no rows; further columns are ignored, and kept
as they are by `exact_dedup`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, SPACE, checkpoint, packed, spread_join, text_of, unpacked

_UNIT = "cast('100000000000000000000' as decimal(21,0))"
_TOP = "cast('9223372036854775808' as decimal(20,0))"


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """More code points first, then the smaller id, null last; unique for (n_chars, doc_id)."""
    code = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (n_chars.cast("decimal(10,0)") * F.expr(_UNIT) + code).cast("decimal(38,0)")


def _unrank(rank: Column) -> tuple[Column, Column]:
    """Code points and id of a rank."""
    code = rank % F.expr(_UNIT)
    n_chars = ((rank - code) / F.expr(_UNIT)).cast("long")
    return n_chars, F.when(code > 0, (F.expr(_TOP) - code).cast("long"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n"), F.regexp_replace(text, SPACE + "+", "").alias("content")).withColumn("digest", F.sha2("content", 256))


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each distinct content: digest, content, rank of the winner, number of rows."""
    rows = _keyed(docs).select("digest", "content", _rank(F.col("n"), F.col("doc_id")).alias("rank"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("salt", "digest", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    return salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and n (code points)."""
    n_keep, keep_id = _unrank(F.col("rank"))
    rows = checkpoint(_keyed(docs).select("doc_id", "n", "digest", F.monotonically_increasing_id().alias("uid")))
    # contents that share a digest are told apart by their content; all others need it no more
    one = winners(docs, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("rank").alias("rank"), F.max("size").alias("size"))
    groups = checkpoint(one.filter("size > 1 or contents > 1"))
    clashing = groups.filter("contents > 1").select("digest")
    if clashing.isEmpty():
        joined = spread_join(rows, groups.drop("contents"), "digest", salts)
    else:
        joined = spread_join(rows.join(clashing, "digest", "left_anti"), groups.filter("contents = 1").drop("contents"), "digest", salts)
        apart = winners(docs, salts).join(clashing, "digest")
        told = _keyed(docs).withColumn("uid", -F.monotonically_increasing_id() - 1).join(apart, ["digest", "content"])
        joined = joined.unionByName(told.select(*joined.columns))
    # a row without a group is the only one of its text
    alone = F.col("rank").isNull()
    told = checkpoint(
        joined.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(keep_id).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n") == n_keep))).alias("best"),
            F.col("digest").alias("text_sha256"),
            "n",
            "uid",
        )
    )
    # repeated rows of the winner: the first of them stays
    first = told.filter("best and group_size > 1").groupBy("text_sha256", "keep_id", "n").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("repeats"))
    others = told.filter("best").join(first.filter("repeats > 1").select("text_sha256", F.col("keep_id").alias("_id"), "n", F.col("uid").alias("_first")), ["text_sha256", "n"]).filter(F.col("keep_id").eqNullSafe(F.col("_id")) & (F.col("uid") != F.col("_first")))
    dropped = others.select("uid", F.lit(True).alias("again"))
    kept = F.col("best") & F.col("again").isNull()
    return told.join(dropped, "uid", "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, all columns as they were."""
    id_ = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "none": F.col("doc_id").isNull()}
    kept = exact_groups(docs, salts).filter("kept").select(*(c.alias(name) for name, c in id_.items()), "n", F.col("text_sha256").alias("digest"))
    text = text_of()
    keyed = packed(docs, **id_, n=F.length(text), digest=F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256), h=F.xxhash64(text))
    key = ["id", "none", "n", "digest"]
    # full repetitions meet in the aggregation, one of a task
    once = keyed.groupBy(*key).agg(F.min_by("row", "h").alias("row"))
    return unpacked(once.join(kept, key, "left_semi"))


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content
  from documents),
w as (
  select doc_id, content,
    first_value(doc_id) over (partition by content order by n desc, doc_id nulls last) as keep_id,
    count(*) over (partition by content) as group_size,
    row_number() over (partition by content order by n desc, doc_id nulls last) as nth
  from t)
select doc_id, keep_id, group_size, nth = 1 as kept, sha256(content) as text_sha256 from w
"""

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sizes are words. The sources, in code-point order and null last, weigh 3, 1, 2, repeating;
the mix is `share` times all words, dealt by weight, but no source gets more than `most`
times its words: what is above is dealt again by weight until none is above. A source with
target t and s words first gives every document floor(t / s) times (complete epochs); of
what is left, documents are taken once more in the order of their exponential keys
-ln(u) / q, u a uniform number from a digest of the id and q the document's quality weight,
as long as the running sum of sizes fits; the document that crosses the budget is taken too
if that brings the sum nearer to it. Documents are taken whole.

A source may hold a third of all rows, so running sums never gather a source in one task:
rows are range-partitioned by (source, key) into blocks, blocks are summed, and each row
adds its block's offset to the running sum inside its block. The positions of sources, which
decide weights, and the level to which sources are filled come from the same device.

Defined cases: a null text has no words; a null source is a source of its own, the last; a
null doc_id has a key like any other; repeated rows are documents of their own, and those
that tie in id, text and source are taken in the order of their other columns; a document
without words is taken zero words; an empty table gives no rows; further columns are
ignored, and kept as they are by `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, block_offsets, checkpoint, n_words, ordered_blocks, packed, row_hash, text_of, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def quality_weight(text: Column) -> Column:
    """Quality weight of a document, 0.25 to 1: the share of ASCII letters and non-ASCII
    characters among all that are not white space."""
    dense = F.length(F.regexp_replace(text, SPACE + "+", ""))
    odd = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]"))
    return F.when(dense > 0, F.greatest(F.lit(0.25), (dense - odd) / dense)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in (0, 1) from 52 bits of a digest of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _earlier(blocked: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """The blocked rows with the sum of a value over all rows before them (`before`)."""
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = blocked.withColumn("before", F.coalesce(inside, F.lit(0))).join(block_offsets(blocked, [], value), "_block")
    return summed.withColumn("before", F.col("before") + F.col("_before")).drop("_before", "_block")


def _sources(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, blocks: int | None) -> DataFrame:
    """One row per source: source, source_size, target."""
    order = [F.col("source").isNull(), F.col("source")]
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _earlier(ordered_blocks(sums, order, blocks), order, F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    table = checkpoint(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    total, heft = table.agg(F.sum("source_size"), F.sum("weight")).first()
    # filled in the order in which sources reach their caps; the level that is left when the
    # first ones are capped is highest where exactly those are capped that must be
    filling = [F.col("cap") / F.col("weight"), *order]
    filled = ordered_blocks(table, filling, blocks)
    full = _earlier(filled, filling, F.col("cap")).select("source", F.col("before").alias("full"))
    light = _earlier(filled, filling, F.col("weight")).select(F.col("source").alias("_source"), F.col("before").alias("light"))
    level = full.join(light, F.col("source").eqNullSafe(F.col("_source"))).agg(F.max((F.lit(float(share)) * F.lit(float(total or 0)) - F.col("full")) / (F.lit(float(heft or 0)) - F.col("light")))).first()[0]
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(float(level or 0))).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), source, size, source_size, target, copies, taken."""
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / (quality_weight(text) if quality is None else quality.cast("double"))).alias("key"),
        F.monotonically_increasing_id().alias("uid"),  # written with the rows; cuts even full repetitions into blocks
    )
    order = ["key", "doc_id", "h", "uid"]
    blocked = ordered_blocks(rows, [F.col("source"), *map(F.col, order)], blocks)
    sources = _sources(blocked, weights, share, most, blocks)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = block_offsets(blocked, ["source"], F.col("size"))
    # offsets and targets by source and block: few rows, one for each source a block
    facts = before.join(sources, same(before, sources)).select(before["source"].alias("_source"), F.col("_block").alias("_at"), "_before", "source_size", "target")
    joined = blocked.join(facts, blocked["source"].eqNullSafe(facts["_source"]) & (F.col("_block") == F.col("_at")))
    running = F.sum("size").over(Window.partitionBy("_block", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_before") + F.coalesce(running, F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    # whole if its end is no further beyond the budget than its start is before it
    once = (F.col("start") < left) & (F.col("start") + F.col("start") + F.col("size") <= 2 * left)
    chosen = joined.withColumns({"start": start, "epochs": epochs}).withColumn("copies", F.col("epochs") + F.when(once, F.lit(1)).otherwise(F.lit(0)))
    return chosen.select("doc_id", "h", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were."""
    chosen = mix(docs)
    # rows of one (id, text, source) may differ in copies: they are numbered on both sides,
    # in the order of all their columns, so that rows that differ always get the same copies
    key = ["id", "none", "h", "s", "alone"]
    ids = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "none": F.col("doc_id").isNull(), "s": F.coalesce(F.col("source").cast("string"), F.lit("")), "alone": F.col("source").isNull()}
    taken = chosen.select(*(c.alias(name) for name, c in ids.items()), "h", "copies")
    taken = taken.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("copies")))
    keyed = packed(docs, **ids, h=F.xxhash64(text_of()), o=row_hash(docs))
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("o")))
    hit = keyed.join(taken, [*key, "n"]).filter("copies > 0")
    return unpacked(hit.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents),
r as (
  select doc_id, source,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as size,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as dense,
    length(regexp_replace(t, '[^!-@\[-`{-~]+', '', 'g')) as odd,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from d),
k as (
  select doc_id, source, size,
    -ln(u) / case when dense > 0 then greatest(0.25::double, (dense - odd)::double / dense::double) else 1.0::double end as key
  from r),
s as (
  select source, sum(size)::bigint as source_size from k group by source),
w as (
  select source, source_size, 2.0::double * source_size as cap,
    case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight
  from s),
f as (
  select *, (1.5::double * (sum(source_size) over ())::double
      - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as lev
  from w),
l as (
  select coalesce(max(lev), 0.0::double) as level from f),
g as (
  select source, source_size, least(cap, weight * level) as target from w, l),
c as (
  select k.doc_id, k.size, g.source_size, g.target, case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as epochs,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0)::double as start
  from k join g on k.source is not distinct from g.source),
e as (
  select *, target - epochs * source_size as rest from c)
select doc_id, size, source_size, target,
  ((epochs + case when start < rest and 2 * start + size <= 2 * rest then 1 else 0 end) * size)::bigint as taken
from e
"""

"""Document fingerprints by order MinHash, in DataFrame operations only.

The k-mers of a text are its runs of k words. Each occurrence of a k-mer gets its number,
so a repeated k-mer counts as often as it occurs, and a hash of (k-mer, number). One
permutation serves all components: a hash's top bits name its bin, and in each bin the two
smallest occurrences are selected, put back into the order in which the text has them, and
hashed as a tuple. Two texts agree in a component if the same occurrences are smallest
there AND stand in the same order, so swapping passages lowers the likeness as edits do.

A fingerprint is the list of its bins that are not empty, six hexadecimal digits each:
two for the bin, four for the tuple. Likeness is the share of equal components among the
bins that at least one of the two has; two fingerprints without any are alike.

Occurrences are numbered without a shuffle and without row-by-row state: the k-mers of a
text are pairs of hash and position, sorting them brings equal k-mers together in text
order, and the numbers follow from where each run begins.

Defined cases: a null or empty text has no k-mers and an empty fingerprint; fewer than k
words are one k-mer; a null doc_id comes after every other id; rows that share a doc_id
have the same next document, the next smaller id, and of several rows with that id the
next is the one with the smallest text; a table of one id has itself as next; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, ordered_blocks, text_of

K = 5
BIN_BITS = 6
_NULL = "cast('-9223372036854775809' as decimal(20,0))"


def _placed(value: Column, position: Column) -> Column:
    return F.struct(value.alias("h"), position.cast("int").alias("i"))


def with_components(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add the components of a text column: array of bin << 16 | tuple hash.

    Each step is a column of its own. The optimizer merges a step into the next one where
    that refers to it once, so an array that is read inside a lambda must be referred to
    outside it as well; else it would be computed for every element.
    """
    w, m, s, at, occ, v, sel = (f"_{name}_{x}" for x in ("words", "kmers", "sorted", "starts", "numbers", "hashes", "selected"))
    top = 64 - BIN_BITS
    col = F.col
    get = lambda a, i: F.get(col(a), i)
    df = df.withColumn(w, F.transform(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    long_enough = F.size(w) >= k
    kmers = F.transform(F.slice(col(w), 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: _placed(F.xxhash64(x, *(get(w, i + j) for j in range(1, k))), i))
    # fewer words: hashed together as one k-mer at position 0
    whole = F.array(_placed(F.aggregate(col(w), F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
    df = df.withColumn(m, F.when(long_enough, kmers).when(F.size(w) > 0, whole).otherwise(F.slice(whole, 1, 0)))
    df = df.withColumn(s, F.sort_array(m))
    starts = F.filter(F.transform(col(s), lambda x, i: F.when((i == 0) | (x["h"] != get(s, i - 1)["h"]), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    df = df.withColumn(at, starts)
    numbers = F.flatten(F.transform(col(at), lambda a, j: F.sequence(F.lit(0), F.coalesce(get(at, j + 1), F.size(s)) - a - 1)))
    df = df.withColumn(occ, numbers)
    df = df.withColumn(v, F.sort_array(F.zip_with(col(s), col(occ), lambda x, o: _placed(F.xxhash64(x["h"], o), x["i"]))))
    # sorted hashes have their bins in runs: the first two of each run stay
    bin_of = lambda x: F.shiftright(x["h"], top)
    df = df.withColumn(sel, F.filter(col(v), lambda x, i: (i < 2) | (bin_of(x) != bin_of(get(v, i - 2)))))

    def component(x: Column, i: Column) -> Column:
        after = get(sel, i + 1)
        paired = after.isNotNull() & (bin_of(after) == bin_of(x))
        first = (i == 0) | (bin_of(x) != bin_of(get(sel, i - 1)))
        ordered = F.when(x["i"] < after["i"], F.xxhash64(x["h"], after["h"])).otherwise(F.xxhash64(after["h"], x["h"]))
        value = F.when(paired, ordered).otherwise(F.xxhash64(x["h"]))
        return F.when(first, F.shiftleft(F.shiftrightunsigned(x["h"], top), 16).bitwiseOR(value.bitwiseAND(F.lit(0xFFFF))))

    df = df.withColumn(name, F.filter(F.transform(col(sel), component), lambda x: x.isNotNull()))
    return df.drop(w, m, s, at, occ, v, sel)


def written(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among the bins that either has."""
    bins = lambda x: F.transform(x, lambda c: F.shiftright(c, 16))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("decimal(20,0)"), F.expr(_NULL))


def next_documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """For each id (key): the id that comes next, and half the code points of its longest text."""
    halves = docs.groupBy(_key(F.col("doc_id")).alias("key")).agg(F.max(F.floor(F.length(text_of()) / 2)).cast("int").alias("need"))
    blocked = ordered_blocks(halves, [F.col("key").desc()], blocks)
    heads = blocked.groupBy("_block").agg(F.max("key").alias("head"))
    # one row a block
    after = heads.select("_block", F.coalesce(F.lead("head").over(Window.orderBy("_block")), F.max("head").over(Window.partitionBy())).alias("wrap"))
    inside = F.lead("key").over(Window.partitionBy("_block").orderBy(F.col("key").desc()))
    return checkpoint(blocked.join(after, "_block").select("key", "need", F.coalesce(inside, F.col("wrap")).alias("next")))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = next_documents(docs)
    base = with_components(docs.select(_key(F.col("doc_id")).alias("key"), text_of().alias("text")), "text", "own", k)
    # Of several rows with the next id the first is sent. Both sides read one exchange by key, as long
    # as nothing stands below it on one side only: a rank would put its limit there, a lag does not.
    earlier = F.lag("key").over(Window.partitionBy("key").orderBy("text"))
    sources = base.withColumn("earlier", earlier).filter("earlier is null").select(F.col("key").alias("next"), F.col("text").alias("more"), F.col("own").alias("others"))
    sent = sources.join(order, "next").select("key", F.expr("substring(more, 1, need)").alias("more"), "others")
    joined = base.join(sent, "key").withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    edited = joined.withColumn("edited", F.expr("concat(substring(text, 1, n - half), substring(more, 1, half))"))
    done = with_components(edited.select("key", "n", "own", "others", "edited"), "edited", "theirs", k)
    doc_id = F.when(F.col("key") != F.expr(_NULL), F.col("key").cast("long"))
    return done.select(
        doc_id.alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("own"), F.col("others")).alias("near_next"),
    )

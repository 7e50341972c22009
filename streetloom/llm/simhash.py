"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes, and the index lists, for each (position, byte), the
fingerprints that have it there. Two that differ in at most d = 2 bits differ in at most
two bytes, so they are in at least 8 - 2 = 6 lists together: the guaranteed minimum.

Lists of single postings hold 1/256 of all fingerprints each, and tallying them pair by
pair would grow with the square of the input. Count filtering shortens them: postings are
ordered by the length of their lists, the shortest first; of two fingerprints that share
six of their eight postings, the six rarest of each have four in common. So each goes
into the intersections of any four of its six rarest lists, 15 of them, and all pairs
that reach the minimum meet in one. There the shared positional bytes of each pair are
tallied over all eight positions, pairs with six or more are retained, and their bits
are compared. What leaves a list are stars, not pairs: at most one link a member.

A list is read as a sorted stream. One that is longer than `LISTED` is not held: its
members go to the intersections of six lists instead, 28 a fingerprint, which have at
most 65,536 distinct members whatever the corpus, as only two bytes are free, and are
tallied in the same way. Copies collapse to distinct fingerprints first.

The five-word form (`near_dedup`, `Wide`) has fingerprints of 256 bits and links those that differ in
at most 44, which texts of a similarity of about 0.8 or more do. No byte need agree then, so the index
finds most pairs only: it holds as many sets of positions as `recall` takes, pairs that meet are tallied
over all bytes, and those that reach a minimum are compared bit by bit. An exact pass follows
(`missed_links`): masks of which one must agree connect every pair that the index has left out.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
fewer than three words are one shingle; a null doc_id never names a component unless all
its members are null; repeated rows are kept by `near_duplicates`, and one of them by
`near_dedup`; an empty table gives no rows; further columns are ignored, and kept as they
are by `near_dedup`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, packed, row_hash, ship, spread_join, text_of, unpacked

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BYTES = 8
MIN_MATCHES = BYTES - MAX_BITS
#: Words hashed at a time, so a very long text needs no more memory than this.
CHUNK = 16384

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lists that are intersected at first, of the rarest ones of a fingerprint.
MET = 4
RAREST = BYTES - MIN_MATCHES + MET
#: Members up to which a list is held.
LISTED = 4096
#: Pairs that are tallied at a time.
PAIRS = 1 << 20
#: Members up to which lists of long fingerprints are compared together.
SHORT = 8
#: Members from which a list of agreeing words is compared by itself.
LONG = 64
#: Long fingerprints of a block, about.
BLOCK = 1 << 18


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)] * size if size == 1 else [b" ".join(words)]
        size = 1
    n = len(words) - size + 1
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : min(start + CHUNK, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        values = np.fromiter((hashed(x, SEED) for x in shingles), np.uint64)
        counts += np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_signed(fingerprint(x)) for x in texts], dtype="int64")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """The rows' doc_id, fingerprint (fp, signed) and a number of their own (uid)."""
    ship(docs.sparkSession)
    found = F.pandas_udf(_fingerprints, "long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(text_of()).alias("fp"), F.monotonically_increasing_id().alias("uid"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member that each of n positions is linked to, by hooking and jumping."""
    i, j, root = np.concatenate([i, j]), np.concatenate([j, i]), np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (a, b) connect, one for each node but the smallest of those together."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(nodes), at[: len(a)], at[len(a) :])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def stars(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (value, root) between the members of a list that share enough bytes and differ in few bits."""
    v = np.unique(np.asarray(values, np.int64))
    n = len(v)
    if n == 2:  # most lists
        x = int(v[0] ^ v[1]) & (1 << 64) - 1
        shared = x.to_bytes(8, "big").count(0)
        return [(int(v[1]), int(v[0]))] if shared >= MIN_MATCHES and x.bit_count() <= MAX_BITS else []
    found, step = [(np.zeros(0, np.int64),) * 2], max(1, PAIRS // max(n, 1))
    for start in range(0, n, step):
        x = (v[start : start + step, None] ^ v[None, :]).view(np.uint64)
        tally = (x.view(np.uint8).reshape(len(x), n, BYTES) == 0).sum(-1, dtype=np.uint8)
        i, j = np.nonzero(tally >= MIN_MATCHES)
        i, j = (k[np.bitwise_count(x[i, j]) <= MAX_BITS] for k in (i, j))
        i = i + start
        found.append((i[i < j], j[i < j]))
    i, j = (np.concatenate(k) for k in zip(*found, strict=True))
    root = _roots(n, i, j)
    return [(int(a), int(b)) for a, b in zip(v, v[root], strict=True) if a != b]


def entries(fps: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersections of lists (which: a bit a position, held: the bytes there) and the fingerprint of each.

    With the places of the lists in order of length (positions x bytes) of any four of the
    six shortest, else of any six.
    """
    fps = np.asarray(fps, np.int64)
    data = fps.astype(">i8").view(np.uint8).reshape(-1, BYTES)
    if place is None:
        chosen, size = np.broadcast_to(np.arange(BYTES), data.shape), MIN_MATCHES
    else:
        chosen, size = np.argsort(place[np.arange(BYTES), data], axis=1)[:, :RAREST], MET
    which, held = [], []
    for members in combinations(range(chosen.shape[1]), size):
        positions = chosen[:, members]
        which.append(np.bitwise_or.reduce(1 << positions, axis=1).astype(np.int16))
        masks = np.bitwise_or.reduce(np.uint64(255) << (8 * (BYTES - 1 - positions)).astype(np.uint64), axis=1)
        held.append((fps.view(np.uint64) & masks).view(np.int64))
    return np.concatenate(which), np.concatenate(held), np.tile(fps, len(which))


def together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Some batches as one, since texts make the session's batches short."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lists(limit: int | None):
    """Links (a, b) of sorted lists; b is null where a is in a list beyond the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, over = [], None  # parts of the list that the last batch ended in, and the one that is too long

        def told(members: np.ndarray) -> list[tuple[int, int | None]]:
            if limit is not None and len(members) > limit:
                return [(int(x), None) for x in members]
            return stars(members)

        last = None
        for batch in together(batches):
            which, held, fps = (batch[c].to_numpy() for c in ("which", "held", "fp"))
            cut = np.flatnonzero((which[1:] != which[:-1]) | (held[1:] != held[:-1])) + 1
            starts, ends, out = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]]), []
            if last is not None and last != (which[0], held[0]):
                if sum(map(len, kept)) > 1:
                    out += told(np.concatenate(kept))
                kept, over = [], None
            first = slice(starts[0], ends[0])
            kept.append(fps[first])
            if len(starts) > 1:  # the first list of the batch is complete, and so are all but the last
                if over == (which[0], held[0]):
                    out += [(int(x), None) for x in fps[first]]
                elif sum(map(len, kept)) > 1:
                    out += told(np.concatenate(kept))
                for k in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                    out += told(fps[starts[k] : ends[k]])
                kept, over = [fps[starts[-1] : ends[-1]]], None
            last = (which[-1], held[-1])
            if limit is not None and (over == last or sum(map(len, kept)) > limit):  # too long to hold: it goes on as it comes
                out += [(int(x), None) for part in kept for x in part]
                kept, over = [], last
            yield _frame(out)
        if sum(map(len, kept)) > 1:
            yield _frame(told(np.concatenate(kept)))

    return run


def _frame(links: list[tuple[int, int | None]]) -> pa.RecordBatch:
    links = list(dict.fromkeys(links))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _met(distinct: DataFrame, place: np.ndarray | None, limit: int | None) -> DataFrame:
    """Links of fingerprints (fp) that meet in an intersection of lists."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(dict(zip(("which", "held", "fp"), entries(batch["fp"].to_numpy(), place), strict=True)))

    met = distinct.select("fp").mapInPandas(index, "which short, held long, fp long").repartition("which", "held").sortWithinPartitions("which", "held")
    return met.mapInArrow(_lists(limit), "a long, b long")


def places(distinct: DataFrame) -> np.ndarray:
    """Places of the 8 x 256 lists in order of length, the shortest first."""
    postings = F.array(*(F.struct(F.lit(p).alias("position"), F.shiftright("fp", 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(255)).cast("int").alias("byte")) for p in range(BYTES)))
    lengths = np.zeros((BYTES, 256), np.int64)
    # one row a list: 2,048 at most
    for r in distinct.select(F.explode(postings).alias("x")).groupBy("x").count().select("x.*", "count").collect():
        lengths[r["position"], r["byte"]] = r["count"]
    place = np.empty(lengths.size, np.int64)
    place[np.argsort(lengths.ravel(), kind="stable")] = np.arange(lengths.size)
    return place.reshape(lengths.shape)


def links(distinct: DataFrame, listed: int = LISTED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp): every pair within the bits is connected by them."""
    ship(distinct.sparkSession)
    found = checkpoint(_met(distinct, places(distinct), listed))
    sure, crowded = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    return sure.unionByName(_met(crowded, None, None))


def _components(distinct: DataFrame, rooted: DataFrame, key: str) -> DataFrame:
    """For each key of distinct fingerprints (with least and copies): its component's root, smallest doc_id
    (component_id), and whether several documents are in the component (several). Those with links have a root."""
    labelled = checkpoint(distinct.join(rooted, key, "left").select(key, "least", F.coalesce("root", key).alias("root"), (F.col("root").isNotNull() | (F.col("copies") > 1)).alias("several")))
    lowest = labelled.filter("several").groupBy("root").agg(F.min("least").alias("lowest"))
    # a component may have a third of all fingerprints
    numbered = labelled.withColumn("uid", F.monotonically_increasing_id())
    return spread_join(numbered, lowest, "root").select(key, "root", F.when(F.col("several"), F.col("lowest")).otherwise(F.col("least")).alias("component_id"), "several")


def groups(found: DataFrame, listed: int = LISTED) -> DataFrame:
    """For each distinct fingerprint (fp): root, component_id and several."""
    distinct = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    return _components(distinct, components(links(distinct.select("fp"), listed)).withColumnRenamed("node", "fp"), "fp")


def _found(found: DataFrame, told: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, uid) with the root of their component and its smallest id (component_id)."""
    facts = told.filter("several").select("fp", F.col("root").alias("_root"), "component_id", "several")
    joined = spread_join(found, facts, "fp")
    alone = F.col("several").isNull()
    return joined.select("doc_id", "fp", "uid", F.col("_root").alias("root"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = checkpoint(with_fingerprint(docs))
    return _found(found, groups(found, listed)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts, whose fingerprints differ in too many bits for the minimum to be guaranteed ------


def bits_apart(similarity: float) -> float:
    """Expected share of bits in which the fingerprints of two equally long texts differ that share their
    shingles to this degree (Jaccard)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Wide:
    """How similar texts are found by long fingerprints.

    At a similarity of 0.8 about 39 of 256 bits differ and 8 or 9 of the 32 bytes agree, too few for
    single sets of positions to be sure. The index therefore has as many sets of `size` positions as it
    takes for two texts of that similarity to agree in one of them with probability `recall`; the size
    grows with the logarithm of the texts, so that lists stay short.
    """

    similarity: float = 0.8
    words: int = 5
    lanes: int = 4
    recall: float = 0.97

    @property
    def n_bytes(self) -> int:
        return 8 * self.lanes

    @property
    def max_bits(self) -> int:
        """Bits of difference that are linked: one standard deviation above the expected ones."""
        p = bits_apart(self.similarity)
        n = 8 * self.n_bytes
        return int(n * p + math.sqrt(n * p * (1 - p)))

    @property
    def min_matches(self) -> int:
        """Bytes that pairs have to share: what all but one in a hundred pairs of the similarity do."""
        p, below, k = (1 - bits_apart(self.similarity)) ** 8, 0.0, 0
        while below + math.comb(self.n_bytes, k) * p**k * (1 - p) ** (self.n_bytes - k) < 0.01:
            below += math.comb(self.n_bytes, k) * p**k * (1 - p) ** (self.n_bytes - k)
            k += 1
        return k

    def size(self, texts: int) -> int:
        return max(2, math.ceil(math.log(max(texts, 1) / 64, 256)))

    def sets(self, size: int) -> np.ndarray:
        """Sets of positions: rotations of random ones, so that all positions serve alike."""
        p = (1 - bits_apart(self.similarity)) ** (8 * size)
        needed = math.ceil(math.log(1 - self.recall) / math.log(1 - p))
        rng, found = np.random.default_rng(size), {}
        while len(found) < needed:
            first = rng.choice(self.n_bytes, size, replace=False)
            for k in range(self.n_bytes):
                found.setdefault(tuple(sorted(int(x + k) % self.n_bytes for x in first)))
        return np.array(list(found)[:needed])


def long_fingerprint(text: str | None, wide: Wide) -> bytes:
    """The SimHash of a text over several lanes, each a mixture of the shingles' XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return bytes(wide.n_bytes)
    size = wide.words if len(words) >= wide.words else len(words)
    n = len(words) - size + 1
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64 * wide.lanes, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : min(start + CHUNK, n) + size - 1]
        values = np.fromiter((hashed(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(size)), strict=False)), np.uint64)
        lanes = np.empty((len(values), wide.lanes), np.uint64)
        for k in range(wide.lanes):  # the finalizer of SplitMix64
            z = values + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            lanes[:, k] = z ^ (z >> np.uint64(31))
        counts += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def alike(a: np.ndarray, b: np.ndarray, wide: Wide) -> np.ndarray:
    """Whether fingerprints (rows of lanes) share enough bytes and, of those that do, differ in few bits."""
    x = a ^ b
    shape = x.shape[:-1]
    found = (x.view(np.uint8).reshape(*shape, 8 * wide.lanes) == 0).sum(-1, dtype=np.uint8) >= wide.min_matches
    found[found] = np.bitwise_count(x[found]).sum(-1, dtype=np.int64) <= wide.max_bits
    return found


def wide_stars(nodes: np.ndarray, fps: np.ndarray, wide: Wide) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) between the members of a list.

    Members that are like the first one are together through it, so only the others are compared
    with all: a list of copies of one text is read once, not pair by pair.
    """
    n = len(nodes)
    near = alike(fps, fps[:1], wide)
    near[0] = True
    left, right = [np.flatnonzero(near)], [np.zeros(int(near.sum()), np.int64)]
    others, step = np.flatnonzero(~near), max(1, PAIRS // (n * wide.lanes))
    for start in range(0, len(others), step):
        some = others[start : start + step]
        i, j = np.nonzero(alike(fps[some][:, None, :], fps[None, :, :], wide))
        left.append(some[i])
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    root = _roots(n, i, j)
    linked = np.flatnonzero(root != np.arange(n))
    return nodes[linked], nodes[root[linked]]


def _wide_lists(wide: Wide):
    """Links (a, b) of lists sorted by key: rows of key, node and the lanes of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return table["key"].to_numpy(), table["node"].to_numpy(), np.stack([table[f"f{k}"].to_numpy() for k in range(wide.lanes)], axis=1).view(np.uint64)

        def told(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size = ends - starts
            small = np.repeat(size <= SHORT, size)
            out = [(np.zeros(0, np.int64),) * 2]
            for apart in range(1, SHORT):  # short lists are compared all at once
                at = np.flatnonzero((key[apart:] == key[:-apart]) & small[apart:])
                at = at[alike(fps[at], fps[at + apart], wide)]
                out.append((node[at + apart], node[at]))
            for k in np.flatnonzero(size > SHORT):
                out.append(wide_stars(node[starts[k] : ends[k]], fps[starts[k] : ends[k]], wide))
            # a member of a large group is in most sets' lists: its links go to the smallest of a batch, which many lists have in common
            pairs = _forest(*(np.concatenate(x) for x in zip(*out, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for table in together(batches):
            rows = read(table)
            if kept and kept[-1][0][-1] != rows[0][0] or len(np.unique(rows[0][[0, -1]])) > 1:
                # all lists but the last are complete
                rows = tuple(np.concatenate(x) for x in zip(*kept, rows, strict=True))
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last:
                    yield told(*(x[:last] for x in rows))
                kept = [tuple(x[last:] for x in rows)]
            else:
                kept.append(rows)
        if kept:
            yield told(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def similar_links(distinct: DataFrame, texts: int, wide: Wide) -> DataFrame:
    """Links (a, b) between the nodes of distinct long fingerprints (node, fp) of similar texts."""
    ship(distinct.sparkSession)
    sets, lanes = wide.sets(wide.size(texts)), [f"f{k}" for k in range(wide.lanes)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            data = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint8).reshape(n, -1)
            key = np.repeat(np.arange(len(sets), dtype=np.int64), n)
            for k in range(sets.shape[1]):
                key = key << 8 | data[:, sets[:, k]].T.ravel()
            words = data.view(np.int64)
            columns = [pa.array(key), pa.array(np.tile(batch["node"].to_numpy(), len(sets))), *(pa.array(np.tile(words[:, k], len(sets))) for k in range(wide.lanes))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", *lanes])

    met = distinct.select("node", "fp").mapInArrow(index, "key long, node long, " + ", ".join(f"{x} long" for x in lanes))
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_lists(wide), "a long, b long").distinct()


def covering(bits: int) -> np.ndarray:
    """Masks of 32 bits, of which one leaves out all differing ones of any two words that differ in so many bits.

    Each position has a vector of bits + 1 coordinates, and a mask holds the positions whose vector has an odd
    product with one of the other vectors: so many equations leave one that is zero at every differing position.
    With 5 bits all masks but one have 16 positions (Reed-Muller).
    """
    top = 1 << bits
    vectors = [top | i & top - 1 for i in range(32)]
    return np.array([sum(((v & x).bit_count() & 1) << i for i, x in enumerate(vectors)) for v in range(1, 2 * top)], np.uint32)


def covered(fps: np.ndarray, label: np.ndarray, parts: list[int], wide: Wide) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, root) that connect the labels of all fingerprints (rows of lanes) within the bits, as far as some
    of the words of 32 bits tell; members of a label are together already. Fewer links than labels, not pairs."""
    values, label = np.unique(label, return_inverse=True)
    n, root = len(fps), np.arange(len(values))
    words, place = fps.view(np.uint32).reshape(n, -1), np.arange(n, dtype=np.uint64)
    apart_bits = lambda a, b: np.bitwise_count(fps[a] ^ fps[b]).sum(-1, dtype=np.int64)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label, root
        node, least = _forest(label[a], label[b])
        to = np.arange(len(values))
        to[node] = least
        label, root = to[label], to[root]

    for part in parts:
        # half of the other bits tell most pairs apart
        lanes = [fps[:, k].copy() for k in range(wide.lanes) if k != part // 2][: max(1, wide.lanes // 2)]
        for mask in covering(wide.max_bits // (2 * wide.lanes)):
            order = np.sort((words[:, part] & mask).astype(np.uint64) << np.uint64(32) | place)
            key, at = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = [lane[at] for lane in lanes]
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            large = ends - starts > LONG
            left, apart = np.flatnonzero(np.repeat(~large, ends - starts)), 1
            while len(left):  # short lists all at once
                left = left[left + apart < n]
                left = left[key[left] == key[left + apart]]
                some = left[sum(np.bitwise_count(x[left] ^ x[left + apart]) for x in first) <= wide.max_bits]
                a, b = at[some], at[some + apart]
                new = label[a] != label[b]
                a, b = a[new], b[new]
                near = apart_bits(a, b) <= wide.max_bits
                if near.any():
                    join(a[near], b[near])
                apart += 1
            for k in np.flatnonzero(large):
                members = at[starts[k] : ends[k]]
                sizes = np.unique(label[members], return_counts=True)
                others, step = members[label[members] != sizes[0][sizes[1].argmax()]], max(1, PAIRS // (len(members) * wide.lanes))
                for start in range(0, len(others), step):
                    some = others[start : start + step]
                    i, j = np.nonzero((apart_bits(some[:, None], members[None, :]) <= wide.max_bits) & (label[some][:, None] != label[members][None, :]))
                    if len(i):
                        join(some[i], members[j])
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def missed_links(distinct: DataFrame, linked: DataFrame, texts: int, wide: Wide, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect every pair of distinct long fingerprints (node, fp) within the bits, however few bytes
    it shares, where `linked` does not connect it already."""
    return _missed(_rooted(distinct, linked), texts, wide, block)


def _rooted(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct fingerprints with the root of what `linked` connects them to (null: nothing)."""
    return distinct.join(components(linked), "node", "left")


def _missed(rooted: DataFrame, texts: int, wide: Wide, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the roots of fingerprints (node, fp, root), which stand for all that is together already.

    Two that differ in 44 of 256 bits differ in at most 5 of one of their eight words, and so agree under one of its
    masks. All fingerprints go to one task for each word, in blocks that meet two by two once there are many; each
    task returns fewer links than it has roots, however many pairs are within the bits.
    """
    blocks, parts = max(1, math.ceil(texts / block)), list(range(2 * wide.lanes))
    shares = [[p] for p in parts] if blocks < 8 else [parts]
    own, other = F.pmod(F.xxhash64("node"), F.lit(blocks)), F.col("_other")
    met = rooted.select("node", "fp", F.coalesce("root", "node").alias("root"))
    met = met.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = met.filter(other != F.col("_own")) if blocks > 1 else met
    met = met.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
    met = met.select("fp", "root", "_share", ((F.least("_own", other) * blocks + F.greatest("_own", other)) * len(shares) + F.col("_share")).alias("_task"))

    def run(table: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        a, b = covered(fps, table["root"].to_numpy(), shares[table["_share"][0].as_py()], wide)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("_task").applyInArrow(run, "a long, b long")


def similar(found: DataFrame, wide: Wide = Wide()) -> DataFrame:  # noqa: B008
    """Rows (doc_id, fp, uid), fp a long fingerprint, with root and component_id."""
    distinct = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    texts = distinct.count()
    rooted = checkpoint(_rooted(distinct, similar_links(distinct, texts, wide)).withColumn("uid", F.monotonically_increasing_id()))
    # what the exact pass adds is between roots: only those are linked anew
    above = components(_missed(rooted, texts, wide)).select(F.col("node").alias("_root"), F.col("root").alias("_above"))
    last = spread_join(rooted.withColumn("_root", F.coalesce("root", "node")), above, "_root").select("node", F.coalesce("_above", "root").alias("root")).filter("root is not null")
    told = _components(distinct, last, "node")
    return _found(found, told.join(distinct.select("node", "fp"), "node"))


def near_dedup(docs: DataFrame, wide: Wide = Wide()) -> DataFrame:  # noqa: B008
    """One document of each group of similar texts, the one with the smallest id; all columns as they were.

    Rows that share that id are told apart by their text, of full repetitions one stays.
    """
    ship(docs.sparkSession)
    id_ = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "none": F.col("doc_id").isNull(), "h": F.xxhash64(text_of())}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([long_fingerprint(x, wide) for x in texts])

    found = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, "binary")(text_of()).alias("fp"), id_["h"].alias("h"), F.monotonically_increasing_id().alias("uid")))
    told = similar(found.select("doc_id", "fp", "uid"), wide).join(found.select("uid", "h"), "uid")
    best = told.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    several = best.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.*")
    keep = several.unionByName(best.filter("root is null").select("doc_id", "h")).select(*(c.alias(name) for name, c in id_.items() if name != "h"), "h")
    once = packed(docs, **id_, o=row_hash(docs)).groupBy(*id_).agg(F.min_by("row", "o").alias("row"))
    return unpacked(once.join(keep, list(id_), "left_semi"))

"""Connected, weak and strong components."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CityGraph
from .arcs import boolean_arcs
from .order import checkpoint, grown

#: Arcs up to which strong components are found by one task instead of by joins: 16 bytes each.
KERNEL_ARCS = 5_000_000


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of links (a, b long): rows (node, root), root the smallest node; isolated nodes do not occur.

    Alternates large-star and small-star steps, each one min-aggregation and one join,
    until the links are stars around their roots: rounds grow with the logarithm of the
    longest path, not with its length. Partial aggregation takes hub nodes.
    """
    edges = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpoint(small)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
    return got[0], got[1]


def _labelled(graph: CityGraph, roots: DataFrame) -> DataFrame:
    """(node_id, component_id): the smallest member names a component; nodes without links are their own."""
    ids = graph.nodes.select("node_id")
    return ids.join(grown(roots.withColumnRenamed("node", "node_id")), "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component_id"))


def weak_components(graph: CityGraph) -> DataFrame:
    """(node_id, component_id), direction ignored."""
    return _labelled(graph, star_components(graph.edges.select(F.col("u").alias("a"), F.col("v").alias("b"))))


def connected_components(graph: CityGraph) -> DataFrame:
    if graph.meta.is_directed:
        raise ValueError("connected components need an undirected graph")
    return weak_components(graph)


def strong_kernel(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the strong component of each of n positions, by one depth-first search with low links."""
    order = np.argsort(src, kind="stable")
    heads, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    found, low, label = [-1] * n, [0] * n, [-1] * n
    path: list[int] = []
    clock = 0
    for start in range(n):
        if found[start] >= 0:
            continue
        found[start] = low[start] = clock
        clock += 1
        path.append(start)
        work = [(start, begin[start])]
        while work:
            v, at = work.pop()
            if at < begin[v + 1]:
                work.append((v, at + 1))
                w = heads[at]
                if found[w] < 0:
                    found[w] = low[w] = clock
                    clock += 1
                    path.append(w)
                    work.append((w, begin[w]))
                elif label[w] < 0:
                    low[v] = min(low[v], found[w])
                continue
            if low[v] == found[v]:
                cut = len(path) - 1
                while path[cut] != v:
                    cut -= 1
                members = path[cut:]
                del path[cut:]
                least = min(members)
                for w in members:
                    label[w] = least
            if work:
                parent = work[-1][0]
                low[parent] = min(low[parent], low[v])
    return np.array(label, np.int64)


def _strong_by_kernel(arcs: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pairs = pd.concat(parts)
        ids, at = np.unique(np.concatenate([pairs["src"], pairs["dst"]]), return_inverse=True)
        label = strong_kernel(at[: len(pairs)], at[len(pairs) :], len(ids))
        yield pd.DataFrame({"node": ids, "root": ids[label]})

    return arcs.coalesce(1).mapInPandas(run, "node long, root long")


def strong_by_joins(arcs: DataFrame) -> DataFrame:
    """(node, root) by colouring, for graphs of any size.

    Each round spreads the greatest id along the arcs; where it comes from a node itself,
    what reaches that node inside its colour is one component and leaves the graph.
    """
    left, done = checkpoint(arcs.filter("src <> dst")), None
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    while not left.isEmpty():
        colour = checkpoint(nodes.select("node", F.col("node").alias("c")))
        while True:
            pushed = left.join(colour, left["src"] == colour["node"]).groupBy("dst").agg(F.max("c").alias("p"))
            raised = checkpoint(colour.join(pushed, colour["node"] == pushed["dst"], "left").select("node", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.col("p") > F.col("c")).alias("up")))
            colour = raised.select("node", "c")
            if raised.filter("up").isEmpty():
                break
        inside = checkpoint(left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        reached = checkpoint(colour.filter("node = c"))
        front = reached
        while not front.isEmpty():
            front = checkpoint(inside.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(reached, ["node", "c"], "left_anti"))
            reached = checkpoint(reached.unionByName(front))
        done = reached if done is None else done.unionByName(reached)
        gone = reached.select("node")
        left = checkpoint(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    if done is None:
        return arcs.sparkSession.createDataFrame([], "node long, root long")
    least = done.groupBy("c").agg(F.min("node").alias("root"))
    return done.join(least, "c").select("node", "root")


def strong_components(graph: CityGraph, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(node_id, component_id) of mutually reachable nodes."""
    if not graph.meta.is_directed:
        warnings.warn("undirected graph: strong components are connected components", stacklevel=2)
        return connected_components(graph)
    pairs = checkpoint(boolean_arcs(graph))
    small = pairs.limit(kernel_arcs + 1).count() <= kernel_arcs
    return _labelled(graph, _strong_by_kernel(pairs) if small else strong_by_joins(pairs))


def sizes(components: DataFrame) -> DataFrame:
    """(component_id, size, least_text, place): largest first, ties by the least member as text."""
    found = components.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("node_id").cast("string")).alias("least_text"))
    return found


def number_of(components: DataFrame) -> int:
    return components.select("component_id").distinct().count()


def by_mode(graph: CityGraph, mode: str = "auto") -> DataFrame:
    if mode not in ("auto", "connected", "weak", "strong"):
        raise ValueError(f"mode must be auto, connected, weak or strong, not {mode}")
    if mode == "auto":
        mode = "strong" if graph.meta.is_directed else "connected"
    return {"connected": connected_components, "weak": weak_components, "strong": strong_components}[mode](graph)


def largest(graph: CityGraph, mode: str = "auto") -> DataFrame:
    """(node_id) of the largest component; of an empty graph no rows."""
    found = checkpoint(by_mode(graph, mode))
    top = sizes(found).orderBy(F.desc("size"), "least_text").limit(1)
    return found.join(F.broadcast(top.select("component_id")), "component_id", "left_semi").select("node_id")  # one row


def keep_largest(graph: CityGraph, mode: str = "auto") -> CityGraph:
    from .edit import subgraph

    return subgraph(graph, largest(graph, mode), check=False)


def ranked_sizes(components: DataFrame) -> DataFrame:
    """Sizes with their place, the largest first; one row a component."""
    from .order import dense_positions

    placed = dense_positions(sizes(components), [F.desc("size"), F.col("least_text")], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))

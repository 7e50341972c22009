"""Shortest paths: single source, several sources, nearest source, one search per source, OD matrices.

Weights and distances are float32 throughout; sums of floats are monotone, so the least
distance is one fixpoint whatever the order of relaxations, and both kernels agree bit
for bit. The owner of a node is not: where two sums round to one, a source passes on what
it had at a node before a nearer one came there. Searches for the nearest source therefore
go arc by arc in rounds, in both kernels and in SQL:

* the array kernel sends the arcs, up to `KERNEL_ARCS` of them, to every executor once and
  relaxes frontiers of many sources at a time in numpy, nearer nodes first, as `mapInPandas` over the
  sources;
* the same from many sources near each other, for matrices: a row of distances a node, relaxed as one;
* the join kernel relaxes a frontier table against the arcs, for graphs of any size.

Distances beyond the cutoff never enter a frontier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CityGraph
from .arcs import arcs as arcs_of
from .order import checkpoint, dense_positions
from .validation import preview

#: Arcs, and nodes, that may be broadcast: 8 bytes an arc and 16 a node, so 120 MB an executor at most; they reach the driver as Arrow, 20 bytes an arc.
KERNEL_ARCS = 5_000_000
#: Distances that a task holds at once.
CELLS = 4_000_000
#: The same for searches side by side: 480 MB.
WIDE_CELLS = 120_000_000
#: Searches side by side at most and at least; fewer go one by one.
WIDE, NARROW = 256, 8
#: Nodes that the sources of searches side by side lie among, about. Sources far from each other would bring each node up again and again.
SPAN = 4096
#: Mean weights that searches side by side go before they look behind.
STRIDES = np.float32(6)
#: Sources of which a worker keeps what they reach.
KNOWN = 32
#: Tasks of searches from many sources, a core.
TASKS = 8
#: Rows of a result that a task gives back at once.
OUT_ROWS = 500_000
#: Labels of objects that a join of their pairs may broadcast: some MB.
LABELS = 200_000
#: A cell that no search has reached.
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def check_cutoff(cutoff: float | None) -> np.float32:
    if cutoff is None:
        return np.float32(np.inf)
    if cutoff < 0:
        raise ValueError(f"cutoff must not be negative: {cutoff}")
    return np.float32(cutoff)


def distances(cell: np.ndarray) -> np.ndarray:
    return (cell >> np.uint64(32)).astype(np.uint32).view(np.float32)


def stride(weights: np.ndarray) -> np.float32:
    """Distance that a search goes before it looks behind: the mean weight. Results do not depend on it."""
    known = weights[np.isfinite(weights)]
    return np.float32(known.mean(dtype=np.float64)) if len(known) else np.float32(0)


def _once(cells: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each of the cells once."""
    turn = np.arange(len(cells), dtype=np.int32)
    mark[cells] = turn
    return cells[mark[cells] == turn]


class Space:
    """Cells of several searches, used again by the next ones: what a search touched is cleared after it."""

    def __init__(self, size: int):
        self.cell, self.mark = np.full(size, NEVER), np.empty(size, np.int32)


def relax(indptr: np.ndarray, heads: np.ndarray, weights: np.ndarray, rows: np.ndarray, seeds: np.ndarray, n_rows: int, cutoff: np.float32, owners: np.ndarray | None = None, space: Space | None = None, rounds: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distances of n_rows searches from seeds (row, position), and the winning owner.

    A cell holds the bits of its distance above its owner's number, so the least cell is
    the least distance and, of equal ones, the least owner. Owners are those of the join
    kernel only by `rounds`, in which all that changed goes on at once.
    """
    n = len(indptr) - 1
    space = space or Space(n_rows * n)
    cell, mark = space.cell, space.mark
    front = rows.astype(np.int64) * n + seeds
    start = np.zeros(len(front), np.uint64) if owners is None else owners.astype(np.uint64)
    np.minimum.at(cell, front, start)
    front = np.unique(front)
    degree, touched, many = np.diff(indptr), [front], n_rows * n // 8
    # What lies beyond the bound waits, or else every path of more arcs that is a little shorter would go all the way again
    width, bound, later = stride(weights), np.float32(np.inf if rounds else 0), []
    while len(front):
        at = front % n
        fan = degree[at]
        source = np.repeat(np.arange(len(front)), fan)
        arc = np.arange(len(source)) + np.repeat(indptr[at] - np.cumsum(fan) + fan, fan)
        state = cell[front][source]
        dist = distances(state) + weights[arc]
        target = (front - at)[source] + heads[arc]
        value = dist.view(np.uint32).astype(np.uint64) << np.uint64(32) | state & np.uint64(0xFFFFFFFF)
        better = (value < cell[target]) & (dist <= cutoff)
        target, value = target[better], value[better]
        np.minimum.at(cell, target, value)
        target = _once(target, mark)
        if touched is not None:
            touched.append(target)
            many -= len(target)
            touched = touched if many > 0 else None
        near = distances(cell[target]) <= bound
        front = target[near]
        later.append(target[~near])
        if not len(front):
            wait = _once(np.concatenate(later), mark)
            dist = distances(cell[wait])
            wait, dist = wait[dist > bound], dist[dist > bound]  # the others have come nearer since
            if len(wait):
                bound = dist.min() + width
                front, later = wait[dist <= bound], [wait[dist > bound]]
    seen = np.flatnonzero(cell[: n_rows * n] != NEVER) if touched is None else np.unique(np.concatenate(touched))
    found = cell[seen]
    if touched is None:
        cell.fill(NEVER)
    else:
        cell[seen] = NEVER
    return seen, found


class Csr:
    """Arcs as arrays, by places in the ascending ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, ids: np.ndarray):
        self.ids = np.sort(ids)
        src, dst = self.place(src).astype(np.int32), self.place(dst).astype(np.int32)
        order = np.argsort(src, kind="stable")
        self.heads, self.weights = dst[order], w.astype(np.float32, copy=False)[order]
        self.indptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]).astype(np.int64)

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


class Wide:
    """Distances of searches side by side, a row a node in the order in which they are reached, used again by the next ones."""

    def __init__(self, n: int, cells: int):
        self.cell, self.slot, self.key = np.empty(cells, np.float32), np.empty(n + 1, np.int64), np.empty(n, np.float32)

    def begin(self, width: int) -> None:
        # without gaps, or else numpy would copy all of it to take some rows; the first row is that of all nodes not reached
        self.dist = self.cell[: len(self.cell) // width * width].reshape(-1, width)
        self.slot.fill(0)
        self.dist[0], self.used = np.inf, 1

    def reach(self, nodes: np.ndarray) -> bool:
        """Rows for nodes that have none, if there is room."""
        end = self.used + len(nodes)
        if end > len(self.dist):
            return False
        self.slot[nodes] = np.arange(self.used, end)
        self.dist[self.used : end] = np.inf
        self.used = end
        return True

    def of(self, nodes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.dist[np.ix_(self.slot[nodes], columns)]

    def one(self, node: int, columns: np.ndarray | int) -> np.ndarray:
        return self.dist[self.slot[node], columns]

    def reached(self, column: int) -> np.ndarray:
        """Whether a search has reached each node."""
        return np.isfinite(self.dist[: self.used, column])[self.slot[:-1]]


class Goals:
    """How far searches side by side have to go for the wanted nodes, from what earlier ones reached.

    A search reaches all that the known ones reach whose source it has reached. If no arc leads out of
    these nodes and its own, they are all; once each wanted one of them has a distance, nothing
    beyond the greatest of these makes one less.
    """

    def __init__(self, csr: Csr, wanted: np.ndarray, known: list[tuple[int, np.ndarray]]):
        self.csr, self.wanted, self.known = csr, wanted, known

    def begin(self, seeds: np.ndarray) -> None:
        self.seeds, self.bound, self.turn, self.next, self.missing = seeds, np.float32(np.inf), 0, 32, None

    def far(self, wide: Wide) -> np.float32:
        """The greatest distance to reach, infinite while it is not known."""
        self.turn += 1
        if np.isfinite(self.bound) or self.turn < self.next:
            return self.bound
        self.next = self.turn + self.turn // 16 + 16
        if self.missing is not None and np.isinf(wide.one(*self.missing)):
            return self.bound
        rest, most = np.arange(len(self.seeds)), np.float32(0)
        for one, reached in self.known:
            same = reached[self.seeds[rest]] & np.isfinite(wide.one(one, rest))  # they reach each other
            columns, rest = rest[same], rest[~same]
            most = max(most, self._greatest(wide, reached, columns))
            if np.isinf(most):
                return self.bound
        for j in rest:
            reached = np.zeros(len(wide.key), bool)
            for one, more in self.known:
                if np.isfinite(wide.one(one, j)):
                    reached |= more
            mine = wide.reached(j)
            own = np.flatnonzero(mine & ~reached)
            fan = self.csr.indptr[own + 1] - self.csr.indptr[own]
            heads = self.csr.heads[np.arange(fan.sum()) + np.repeat(self.csr.indptr[own] - np.cumsum(fan) + fan, fan)]
            if not (reached[heads] | mine[heads]).all():
                return self.bound
            reached[own] = True
            most = max(most, self._greatest(wide, reached, np.array([j])))
            if np.isinf(most):
                return self.bound
        self.bound = most
        return self.bound

    def _greatest(self, wide: Wide, reached: np.ndarray, columns: np.ndarray) -> np.float32:
        goals, most = self.wanted[reached[self.wanted]], np.float32(0)
        for k in range(0, len(goals), 4096) if len(columns) else ():
            part = wide.of(goals[k : k + 4096], columns)
            most = max(most, part.max())
            if np.isinf(most):
                at = np.argwhere(np.isinf(part))[-1]
                self.missing = goals[k + at[0]], columns[at[1]]
                break
        return most

    def learn(self, wide: Wide) -> None:
        """From searches that went to their ends; of sources that reach each other one is kept."""
        for j, seed in enumerate(self.seeds):
            if len(self.known) >= KNOWN:
                return
            if not any(reached[seed] and np.isfinite(wide.one(one, j)) for one, reached in self.known):
                self.known.append((int(seed), wide.reached(j)))


def relax_wide(csr: Csr, seeds: np.ndarray, cutoff: np.float32, wide: Wide, goals: Goals | None = None) -> bool:
    """One search from each seed, side by side in `wide`; False if that has not enough room.

    A node waits by the least of its distances, since those of near sources come together.
    """
    wide.begin(len(seeds))
    dist, slot, key, inf = wide.dist, wide.slot, wide.key, np.float32(np.inf)
    degree, width, most = np.diff(csr.indptr), stride(csr.weights) * STRIDES, max(1, CELLS // len(seeds))
    front = np.unique(seeds)
    if not wide.reach(front):
        return False
    dist[slot[seeds], np.arange(len(seeds))] = 0
    key[front] = 0
    bound, later = np.float32(0), []
    if goals is not None:
        goals.begin(seeds)
    while len(front):
        fan, rest = degree[front], None
        ends = fan.cumsum()
        if ends[-1] > most:
            k = max(1, int(ends.searchsorted(most, "right")))
            front, rest, fan, ends = front[:k], front[k:], fan[:k], ends[:k]
        source = slot[front].repeat(fan)
        arc = np.arange(len(source)) + (csr.indptr[front] - ends + fan).repeat(fan)
        target = csr.heads[arc]
        order = target.argsort(kind="stable")
        arc, target = arc[order], target[order]
        value = dist.take(source[order], axis=0)
        value += csr.weights[arc, None]
        if cutoff < inf:
            value[value > cutoff] = inf
        first = np.ones(len(target), bool)
        np.not_equal(target[1:], target[:-1], out=first[1:])
        at = first.nonzero()[0]
        if len(at) < len(first):  # the arcs of a target go into its first, all seconds together, then all thirds
            more = (~first).nonzero()[0]
            into = at[first.cumsum()[more] - 1]
            place = more - into
            for k in range(1, place.max() + 1):
                nth = place == k
                value[into[nth]] = np.minimum(value[into[nth]], value[more[nth]])
            value, target = value[at], target[at]
        old = dist.take(slot[target], axis=0)
        better = (value < old).any(axis=1).nonzero()[0]
        target, value = target[better], np.minimum(value[better], old[better])
        row = slot[target]
        if not row.all():
            if not wide.reach(target[row == 0]):
                return False
            row = slot[target]
        dist[row] = value
        least = value.min(axis=1, initial=inf)
        key[target] = least
        near = least <= bound
        front = target[near]
        later.append(target[~near])
        if rest is not None:
            front = np.concatenate([rest, front])
        if not len(front):
            wait = np.unique(np.concatenate(later))
            least = key[wait]
            wait, least = wait[least > bound], least[least > bound]  # the others have come nearer since
            if len(wait):
                start = least.min()
                if goals is not None and start >= goals.far(wide):
                    return True
                bound = start + width
                front, later = wait[least <= bound], [wait[least > bound]]
    if goals is not None:
        goals.learn(wide)
    return True


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of points on a curve through the plane, the bits of both by turns; what is near on it mostly is near in the plane."""
    x, y = (np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0) for c in (x, y))
    x, y = x - x.min(initial=np.inf), y - y.min(initial=np.inf)
    extent = max(x.max(initial=0.0), y.max(initial=0.0)) or 1.0
    code = np.zeros(len(x), np.uint64)
    for turn, c in enumerate((x, y)):
        cell = (c / extent * (2**21 - 1)).astype(np.uint64)
        for bit in range(21):
            code |= (cell >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + turn)
    return code


def _arcs(graph: CityGraph, weight: str | None, reverse: bool) -> DataFrame:
    found = arcs_of(graph, weight)
    if reverse and graph.meta.is_directed:
        found = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    found = checkpoint(found)
    if not found.filter("w < 0").isEmpty():
        raise ValueError("negative weights")
    return found


def _small(arcs: DataFrame, nodes: DataFrame, limit: int) -> bool:
    return arcs.count() <= limit and nodes.count() <= limit


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of numbers; they reach the driver as Arrow, since a row of Python objects takes hundreds of bytes."""
    return [c.to_numpy() for c in df.toArrow().columns]


def _collected(graph: CityGraph, arcs: DataFrame) -> Csr:
    return Csr(*_arrays(arcs.select("src", "dst", "w")), *_arrays(graph.nodes.select(F.col("node_id").cast("long"))))


def _require(graph: CityGraph, sources: DataFrame, column: str = "source") -> None:
    missing = sources.select(F.col(column).alias("node_id")).join(graph.nodes.select("node_id"), "node_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"not nodes of the graph: {preview(missing)}")


def per_source(graph: CityGraph, sources: DataFrame, weight: str | None = None, cutoff: float | None = None, reverse: bool = False, max_workers: int | None = None, kernel_arcs: int = KERNEL_ARCS, targets: DataFrame | None = None, arcs: DataFrame | None = None) -> DataFrame:
    """(source, node, dist float) of independent searches; a source given twice is searched once.

    Of `targets` (node), only the rows of these nodes are returned. `arcs` are those of the graph where they are at hand.
    """
    limit = check_cutoff(cutoff)
    if max_workers is not None and max_workers < 1:
        raise ValueError(f"max_workers must be at least 1: {max_workers}")
    seeds = sources.select(F.col("source").cast("long").alias("source")).distinct()
    _require(graph, seeds)
    arcs = arcs if arcs is not None else _arcs(graph, weight, reverse)
    wanted = targets.select(F.col("node").cast("long").alias("node")).distinct() if targets is not None else None
    if not _small(arcs, graph.nodes, kernel_arcs):
        start = seeds.select("source", F.col("source").alias("node"), F.lit(0.0).cast("float").alias("dist"), F.lit(0).cast("long").alias("owner"))
        found = _by_joins(arcs, start, limit).select("source", "node", "dist")
        return found if wanted is None else found.join(wanted, "node", "left_semi").select("source", "node", "dist")
    csr = _collected(graph, arcs)
    asked = None
    if wanted is not None:
        asked = np.isin(csr.ids, _arrays(wanted)[0])
    sent = graph.spark.sparkContext.broadcast((csr, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csr, asked = sent.value
        n = max(len(csr.ids), 1)
        step = max(1, CELLS // n)
        space = None
        for batch in batches:
            some = batch["source"].to_numpy()
            for k in range(0, len(some), step):
                part = some[k : k + step]
                space = space or Space(step * n)
                seen, cell = relax(csr.indptr, csr.heads, csr.weights, np.arange(len(part)), csr.place(part), len(part), limit, space=space)
                if asked is not None:
                    kept = asked[seen % n]
                    seen, cell = seen[kept], cell[kept]
                for i in range(0, len(seen), OUT_ROWS):
                    at = seen[i : i + OUT_ROWS]
                    yield pd.DataFrame({"source": part[at // n], "node": csr.ids[at % n], "dist": distances(cell[i : i + OUT_ROWS])})

    # a number, as sources are small and adaptive plans would search from all of them in one task
    dealt = seeds.repartition(max_workers or TASKS * graph.spark.sparkContext.defaultParallelism, "source")
    return dealt.mapInPandas(run, "source long, node long, dist float")


def _from_many(graph: CityGraph, seeds: DataFrame, arcs: DataFrame, limit: np.float32, kernel_arcs: int, rounds: bool) -> DataFrame:
    """(node, dist, owner) from seeds (node, owner) in one search; owner is the seed's position, and that of SQL by `rounds`."""
    if not _small(arcs, graph.nodes, kernel_arcs):
        start = seeds.select(F.lit(0).cast("long").alias("source"), "node", F.lit(0.0).cast("float").alias("dist"), "owner")
        return _by_joins(arcs, start, limit).select("node", "dist", "owner")
    # the seeds are at most all nodes, which are no more than the limit
    sent = graph.spark.sparkContext.broadcast((_collected(graph, arcs), *_arrays(seeds.select("node", "owner"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            csr, nodes, owners = sent.value
            seen, cell = relax(csr.indptr, csr.heads, csr.weights, np.zeros(len(nodes), np.int64), csr.place(nodes), 1, limit, owners, rounds=rounds)
            for i in range(0, len(seen), OUT_ROWS):
                part = cell[i : i + OUT_ROWS]
                yield pd.DataFrame({"node": csr.ids[seen[i : i + OUT_ROWS]], "dist": distances(part), "owner": (part & np.uint64(0xFFFFFFFF)).astype(np.int64)})

    return graph.spark.range(1).mapInPandas(run, "node long, dist float, owner long")


def _by_joins(arcs: DataFrame, start: DataFrame, limit: np.float32) -> DataFrame:
    """Fixpoint of (source, node) → least (dist, owner), by joins of the frontier with the arcs."""
    best = checkpoint(start.groupBy("source", "node").agg(F.min(F.struct("dist", "owner")).alias("b")))
    front = best
    while not front.isEmpty():
        step = front.join(arcs, front["node"] == arcs["src"]).select("source", F.col("dst").alias("node"), (F.col("b.dist") + F.col("w")).cast("float").alias("dist"), F.col("b.owner").alias("owner"))
        step = step.filter(F.col("dist") <= F.lit(float(limit)).cast("float")).groupBy("source", "node").agg(F.min(F.struct("dist", "owner")).alias("n"))
        front = checkpoint(step.join(best, ["source", "node"], "left").filter(F.col("b").isNull() | (F.col("n") < F.col("b"))).select("source", "node", F.col("n").alias("b")))
        best = checkpoint(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    return best.select("source", "node", F.col("b.dist").alias("dist"), F.col("b.owner").alias("owner"))


def single_source(graph: CityGraph, source: int, weight: str | None = None, cutoff: float | None = None, reverse: bool = False, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(node, dist) of the reachable nodes."""
    one = graph.spark.createDataFrame([(int(source),)], "source long")
    return per_source(graph, one, weight, cutoff, reverse, kernel_arcs=kernel_arcs).select("node", "dist")


def _seeds(graph: CityGraph, sources: DataFrame) -> DataFrame:
    """(node, owner): distinct sources with their place in node order."""
    wanted = sources.select(F.col("source").cast("long").alias("source")).distinct()
    _require(graph, wanted)
    order = [F.col(c) for c in ("pos", "node_id") if c in graph.nodes.columns]
    placed = dense_positions(graph.nodes.select("node_id", *(["pos"] if "pos" in graph.nodes.columns else [])), order, "owner")
    return checkpoint(placed.join(wanted.withColumnRenamed("source", "node_id"), "node_id", "left_semi").select(F.col("node_id").alias("node"), "owner"))


def multi_source(graph: CityGraph, sources: DataFrame, weight: str | None = None, cutoff: float | None = None, reverse: bool = False, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(node, dist) from the nearest of several sources."""
    limit = check_cutoff(cutoff)
    return _from_many(graph, _seeds(graph, sources), _arcs(graph, weight, reverse), limit, kernel_arcs, rounds=False).select("node", "dist")


def nearest_source(graph: CityGraph, sources: DataFrame, weight: str | None = None, cutoff: float | None = None, reverse: bool = False, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(node, source, dist); of equally near sources the first in node order wins."""
    limit, seeds = check_cutoff(cutoff), _seeds(graph, sources)
    found = _from_many(graph, seeds, _arcs(graph, weight, reverse), limit, kernel_arcs, rounds=True)
    return found.join(seeds.select("owner", F.col("node").alias("source")), "owner").select("node", "source", "dist")


def od_matrix(graph: CityGraph, origins: DataFrame, destinations: DataFrame, weight: str | None = None, threshold: float | None = None, max_workers: int | None = None, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(origin_id, dest_id, dist) of pairs within the threshold, labels (object_id, node_id) on both sides.

    Searches start from the side with fewer distinct nodes; from the destinations on turned arcs.
    """
    if max_workers is not None and max_workers < 1:
        raise ValueError(f"max_workers must be at least 1: {max_workers}")
    sides = {"origin": origins.select(F.col("object_id").alias("origin_id"), F.col("node_id").alias("origin")), "dest": destinations.select(F.col("object_id").alias("dest_id"), F.col("node_id").alias("dest"))}
    for name, side in sides.items():
        if side.isEmpty():
            raise ValueError(f"no {name}s")
        _require(graph, side, name)
    counts = {name: side.select(name).distinct().count() for name, side in sides.items()}
    turned = counts["dest"] < counts["origin"]
    start, stop = ("dest", "origin") if turned else ("origin", "dest")
    light = {name: side.count() <= LABELS for name, side in sides.items()}
    limit, arcs = check_cutoff(threshold), _arcs(graph, weight, turned)
    if all(light.values()) and _small(arcs, graph.nodes, kernel_arcs):
        csr = _collected(graph, arcs)
        n = len(csr.ids)
        if min(WIDE_CELLS // (n + 1), -(-counts[start] * SPAN // n)) >= NARROW and float(csr.weights.max(initial=0)) * n < np.finfo(np.float32).max:
            tasks = max_workers or TASKS * graph.spark.sparkContext.defaultParallelism
            return _by_rows(graph, csr, *((sides[name], f"{name}_id", name) for name in (start, stop)), limit, tasks).select("origin_id", "dest_id", "dist")
    found = per_source(graph, sides[start].select(F.col(start).alias("source")), weight, threshold, turned, max_workers, kernel_arcs, sides[stop].select(F.col(stop).alias("node")), arcs)
    found = found.select(F.col("source").alias(start), F.col("node").alias(stop), "dist")
    # only here, as the hint would go along with the sources to the pairs
    hinted = {name: F.broadcast(side) if light[name] else side for name, side in sides.items()}
    return found.join(hinted[stop], stop).join(hinted[start], start).select("origin_id", "dest_id", "dist")


def _labels(graph: CityGraph, side: DataFrame, label: str, node: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The labels of a side and their nodes, along the curve."""
    points = graph.nodes.select(F.col("node_id").cast("long").alias("_node"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).dropDuplicates(["_node"])
    found = side.select(F.col(label), F.col(node).cast("long").alias("_node")).join(points, "_node").select(label, "_node", "_x", "_y").toArrow().combine_chunks()
    nodes, x, y = (found[c].to_numpy() for c in ("_node", "_x", "_y"))
    order = np.lexsort((nodes, curve(x, y)))
    column = found[label].combine_chunks()
    return (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).take(pa.array(order)), nodes[order]


def _by_rows(graph: CityGraph, csr: Csr, start: tuple[DataFrame, str, str], stop: tuple[DataFrame, str, str], limit: np.float32, tasks: int) -> DataFrame:
    """(label of start, label of stop, dist) by searches side by side, from runs of the sources along the curve."""
    (names, seeds), (others, ends) = (_labels(graph, *side) for side in (start, stop))
    new = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))  # a node's labels are beside each other
    sent = graph.spark.sparkContext.broadcast((csr, [], names, csr.place(seeds[new]), np.append(new, len(seeds)), others, csr.place(ends)))
    tasks = max(1, min(tasks, len(new)))
    most = max(1, min(WIDE, -(-len(new) * SPAN // len(csr.ids))))
    width, cells = min(most, WIDE_CELLS // (len(csr.ids) + 1)), min(WIDE_CELLS, most * (len(csr.ids) + 1))
    schema = pa.schema([(start[1], names.type), (stop[1], others.type), ("dist", pa.float32())])
    types = ", ".join(f"`{label}` {side.schema[label].dataType.simpleString()}" for side, label, _ in (start, stop)) + ", dist float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csr, known, names, seeds, first, others, ends = sent.value
        wide, goals = None, Goals(csr, np.unique(ends), known) if np.isinf(limit) else None
        some = max(1, OUT_ROWS // len(ends))
        for batch in batches:
            for task in batch.column(0).to_pylist():
                a, high, side = len(seeds) * task // tasks, len(seeds) * (task + 1) // tasks, width
                wide = wide or Wide(len(csr.ids), cells)
                while a < high:
                    parts = -(-(high - a) // side)
                    b = a + -(-(high - a) // parts)
                    if not relax_wide(csr, seeds[a:b], limit, wide, goals):
                        side = max(width, (b - a) // 2)
                        continue
                    column = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
                    for k in range(0, len(column), some):
                        found = np.ascontiguousarray(wide.of(ends, column[k : k + some]).T)
                        name, end = np.nonzero(np.isfinite(found))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(name + (first[a] + k))), others.take(pa.array(end)), pa.array(found[name, end])], schema=schema)
                    # the next ones are near these and reach about as many nodes
                    side = min(most, max(width, int(0.9 * cells / wide.used)))
                    a = b

    return graph.spark.range(0, tasks, 1, tasks).mapInArrow(run, types)


def dense(matrix: DataFrame) -> DataFrame:
    """Wide form of an OD matrix: one row per origin, missing pairs infinite."""
    wide = matrix.groupBy("origin_id").pivot("dest_id").agg(F.min("dist"))
    return wide.na.fill(float("inf"))

"""Nearest neighbours by vantage-point trees, one a shard, with triangle-inequality pruning that a factor relaxes.

1. Equal vectors become one class, which keeps the smallest ids that any search can need; a vector that fills a third of the
   table is one point of one tree.
2. The upper levels of a vantage-point tree are fitted on a bounded sample and deal all classes to cells, so shards hold what
   is close together. For every cell the least and greatest distance to each vantage point above it are taken from all
   of its rows. A cell above the size of a shard is dealt to several.
3. Every shard builds a tree of its own. Queries search the shard of their own vector first, which bounds the distance of
   their last neighbour; they then visit every other shard that the triangle inequality does not rule out.

A branch is left out if the least distance that its vantage points allow, times ``factor``, is above the distance of the last
neighbour so far. Factor one is exact; a larger one visits less and may miss neighbours. Distances are sums in the order of
the components, in double precision, whatever was used to rule candidates out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import in_batches

#: Rows of the sample that the upper levels are fitted on (of each length of vectors; below twice as many are read); bytes of a shard's vectors; queries of
#: a shard that one task searches; points of a leaf; rows of a table that may be broadcast.
SAMPLE, SHARD_BYTES, QUERIES, LEAF, SMALL = 16_384, 4 << 20, 4096, 64, 100_000
#: Share by which a bound has to exceed a distance before a branch is left out, for rounding.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b`` (or one row), summed in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for k in range(a.shape[1]):
            step = a[:, k] - b[..., k]
            total += step * step
    return np.sqrt(total)


def _packed(x: np.ndarray) -> bytes:
    """A vector of doubles in 4 bytes a component where that is exact, else in 8."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else x.astype("<f8")).tobytes()


def _vectors(packed: pd.Series, dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    for k, raw in enumerate(packed):
        out[k] = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8")
    return out


def _valid(vectors: pd.Series) -> list[np.ndarray | None]:
    """Vectors as doubles, negative zeros as zeros; None where a vector is null, empty, zero or not finite throughout."""
    out = []
    for v in vectors:
        x = None if v is None else np.asarray(v, np.float64) + 0.0
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


@dataclass
class Upper:
    """Upper levels of a tree: vantage points and radii in heap order; a vector goes right where it is not nearer."""

    points: np.ndarray
    radii: np.ndarray
    levels: int

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and its distances to the vantage points above it."""
        at, path = np.zeros(len(x), np.int64), np.zeros((len(x), self.levels))
        for k in range(self.levels):
            path[:, k] = distances(x, self.points[at])
            at = 2 * at + 1 + (path[:, k] >= self.radii[at])
        return at - ((1 << self.levels) - 1), path


def fit(x: np.ndarray, levels: int) -> Upper:
    """Fit levels on a sample: a vantage point is the sample point farthest from another, the radius the median distance."""
    n = (1 << levels) - 1
    points, radii = np.zeros((n, x.shape[1])), np.zeros(n)
    groups: list[np.ndarray] = [np.arange(len(x))]
    for node in range(n):
        own = groups[node]
        if len(own):
            points[node] = x[own[np.argmax(distances(x[own], x[own[0]]))]]
            d = distances(x[own], points[node])
            radii[node] = np.median(d)
            groups += [own[d < radii[node]], own[d >= radii[node]]]
        else:
            groups += [own, own]
    return Upper(points, radii, levels)


class Tree:
    """A vantage-point tree over the points of a shard; searched by many queries at once."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray]) -> None:
        """``ids``: of each point, ascending."""
        self.x, self.ids = x, ids
        self.first = np.array([i[0] for i in ids], np.int64)
        with np.errstate(over="ignore"):
            self.squares = np.einsum("ij,ij->i", x, x)
        self.nodes: list[tuple] = []  # a leaf's points, or vantage point, children and their least and greatest distance
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            if parent >= 0:
                self.nodes[parent][1][side] = len(self.nodes)
            if len(own) <= LEAF:
                self.nodes.append((own, None, None))
                continue
            point = own[np.argmax(distances(x[own], x[own[0]]))]
            d = distances(x[own], x[point])
            half = np.argsort(d, kind="stable")
            parts = half[: len(own) // 2], half[len(own) // 2 :]
            self.nodes.append((point, [0, 0], [(d[p].min(), d[p].max()) for p in parts]))
            todo += [(own[p], len(self.nodes) - 1, k) for k, p in enumerate(parts)]

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places (-1: none) of the ``k`` nearest points of each query that are not beyond its bound."""
        best, place, low = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.iinfo(np.int64).max)
        limit = bound.astype(np.float64).copy()
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.einsum("ij,ij->i", q, q)
            done = np.full(len(q), -1, np.int64)

            def leaf(node: int, who: np.ndarray) -> None:
                own = self.nodes[node][0]
                sums = squares[who][:, None] + self.squares[own]
                rough = sums - 2 * (q[who] @ self.x[own].T)
                a, b = np.nonzero(~(rough > (limit[who] ** 2)[:, None] + SLACK * sums))
                d = distances(q[who[a]], self.x[own[b]])
                fits = ~(d > limit[who[a]])
                a, b, d = a[fits], b[fits], d[fits]
                for row in np.unique(a):
                    i, new = who[row], slice(*np.searchsorted(a, (row, row + 1)))
                    every = np.r_[best[i], d[new]], np.r_[place[i], own[b[new]]], np.r_[low[i], self.first[own[b[new]]]]
                    first = np.lexsort((every[2], every[0]))[:k]
                    best[i], place[i], low[i] = (x[first] for x in every)
                    if place[i, -1] >= 0:
                        limit[i] = min(limit[i], best[i, -1])

            # to the leaf that each query would be in, then to all that its limit leaves
            todo = [(0, np.arange(len(q)))]
            while todo:
                node, who = todo.pop()
                point, children, ranges = self.nodes[node]
                if children is None:
                    leaf(node, who)
                    done[who] = node
                    continue
                right = distances(q[who], self.x[point]) >= ranges[1][0]
                todo += [(c, w) for c, w in zip(children, (who[~right], who[right]), strict=True) if len(w)]
            todo = [(0, np.arange(len(q)))]
            while todo:
                node, who = todo.pop()
                point, children, ranges = self.nodes[node]
                if children is None:
                    if len(who := who[done[who] != node]):
                        leaf(node, who)
                    continue
                d = distances(q[who], self.x[point])
                for c, (near, far) in zip(children, ranges, strict=True):
                    least = np.maximum(np.maximum(near - d, d - far), 0)
                    if len(w := who[~(least * factor > limit[who] * (1 + SLACK) + SLACK * d)]):
                        todo.append((c, w))
        return best, place


def _search(k: int, factor: float):
    """Rows (shard, part, kind, key, dim, vec, ids, bound) in this order: points of a shard are kind 0, its queries kind 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, points, tree = None, [], None
        for pdf in batches:
            out = []
            for group, own in pdf.groupby(["shard", "part", "kind"], sort=False):
                dim = int(own["dim"].iloc[0])
                if group[:2] != now:
                    now, points, tree = group[:2], [], None
                if group[2] == 0:
                    points.append((_vectors(own["vec"], dim), list(own["ids"])))
                    continue
                if tree is None:
                    tree = Tree(np.concatenate([p[0] for p in points]), [i for p in points for i in p[1]])
                best, place = tree.search(_vectors(own["vec"], dim), own["bound"].to_numpy(), k, factor)
                for key, d, at in zip(own["key"], best, place, strict=True):
                    each = sorted((float(x), int(i)) for x, p in zip(d, at, strict=True) if p >= 0 for i in tree.ids[p])[:k]
                    out += [(key, i, x) for x, i in each]
            yield pd.DataFrame(out, columns=["key", "id", "d"])

    return run


def _dealt(rows: DataFrame, levels: dict[int, Upper]) -> DataFrame:
    """``rows`` (id, v) that take part: id, key (equal vectors, equal keys), dim, vec, cell, path."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [(i, x) for i, x in zip(pdf["id"], _valid(pdf["v"]), strict=True) if x is not None]
            for dim in sorted({len(x) for _, x in own}):
                ids, x = zip(*((i, x) for i, x in own if len(x) == dim), strict=True)
                x = np.stack(x)
                upper = shared.value.get(dim)
                cells, paths = upper.deal(x) if upper else (np.zeros(len(x), np.int64), np.zeros((len(x), 0)))
                yield pd.DataFrame({"id": ids, "key": [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x], "dim": dim, "vec": [_packed(v) for v in x], "cell": cells, "path": list(paths)})

    return rows.transform(in_batches, run, "id long, key binary, dim int, vec binary, cell int, path array<double>")


def _fitted(rows: DataFrame, shard_bytes: int, sample: int) -> dict[int, Upper]:
    """Upper levels for every length of vectors of which there is more than one shard."""
    counts = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") * F.col("dim") * 8 > shard_bytes).collect()
    out = {}
    for dim, n in sorted(map(tuple, counts)):
        some = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0)).select("v").toPandas()
        known = [x for x in _valid(some["v"]) if x is not None]
        x = np.unique(np.stack(known), axis=0) if known else np.zeros((0, dim))
        shards = max(1, -(-n * dim * 8 // shard_bytes))
        levels = min((shards - 1).bit_length(), max(0, (len(x) // 4).bit_length() - 1))
        if levels:
            out[dim] = fit(np.random.default_rng(0).permutation(x), levels)
    return out


def _visits(shards: dict[int, dict[int, tuple[int, int, np.ndarray, np.ndarray]]], levels: dict[int, Upper], factor: float):
    """The shards that a query (key, dim, vec, shard, bound) has to visit beyond its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                cells, upper, bound, x = shards[dim], levels.get(dim), own["bound"].to_numpy(), _vectors(own["vec"], dim)
                away = np.stack([distances(x, p) for p in upper.points], axis=1) if upper else np.zeros((len(x), 0))
                for cell, (first, parts, low, high) in cells.items():
                    least = np.zeros(len(x))
                    node = cell + ((1 << upper.levels) - 1) if upper else 0
                    for k in range(len(low) - 1, -1, -1):
                        node = (node - 1) // 2
                        least = np.maximum(least, np.maximum(low[k] - away[:, node], away[:, node] - high[k]))
                    with np.errstate(invalid="ignore"):
                        goes = ~(least * factor > bound * (1 + SLACK) + SLACK * (away.max(axis=1) if upper else 0))
                    for shard in range(first, first + parts):
                        if (there := goes & (own["shard"].to_numpy() != shard)).any():
                            yield own[there].assign(shard=shard)

    return run


def nearest(rows: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of ``rows`` (vec_id, embedding) for each query row.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but the query's own. Nearness is the
    Euclidean distance, ties go to the smaller vec_id; a query with fewer candidates has as many rows. Null vectors, empty
    ones, zero ones and those with a null or non-finite component take no part, nor do rows with a null vec_id; vectors of
    different lengths are never neighbours. Repeated rows are rows of their own: each is a candidate for the others. An empty
    table gives an empty result; other columns are not read.
    """
    own = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.where("v is not null")
    levels = _fitted(own, shard_bytes, sample)
    dealt = stored(_dealt(own, levels), "ann-rows")
    order = Window.partitionBy("key").orderBy("id")
    first = dealt.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    first = first.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), *(F.first(c).alias(c) for c in ("dim", "vec", "cell", "path")))
    classes = stored(first, "ann-classes")
    deepest = max((u.levels for u in levels.values()), default=0)
    ends = [f(F.get("path", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(deepest) for f in (F.min, F.max)]
    cells: dict[int, dict[int, tuple[int, int, np.ndarray, np.ndarray]]] = {}
    table, shard = [], 0
    for r in sorted(classes.groupBy("dim", "cell").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: (r["dim"], r["cell"])):
        parts, depth = -(-r["n"] * r["dim"] * 8 // shard_bytes), levels[r["dim"]].levels if r["dim"] in levels else 0
        cells.setdefault(r["dim"], {})[r["cell"]] = shard, parts, *(np.array([r[f"{f}{j}"] for j in range(depth)]) for f in ("min", "max"))
        table.append((r["dim"], r["cell"], shard, parts))
        shard += parts
    spark = rows.sparkSession
    places = F.broadcast(spark.createDataFrame(table, "dim int, cell int, first int, parts int"))  # at most a row for four of the sample
    points = classes.join(places, ["dim", "cell"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    asked = stored(dealt.where(F.col("id") % every == 0).select("id", "key"), "ann-asked")
    wanted = asked.select("key").distinct()
    queries = stored(points.join(wanted.hint("merge"), "key", "left_semi").select("key", "dim", "vec", "shard", F.lit(float("inf")).alias("bound")), "ann-queries")

    def searched(visits: DataFrame) -> DataFrame:
        """The nearest of every query in each shard that it visits; a shard's queries are dealt to several tasks if many."""
        load = stored(visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks")), "ann-load")
        load = F.broadcast(load) if load.count() <= SMALL else load.hint("merge")
        there = points.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.lit(0).alias("kind"), "key", "dim", "vec", "ids", F.lit(0.0).alias("bound"))
        come = visits.join(load, "shard").select("shard", F.pmod(F.xxhash64("key"), "tasks").cast("int").alias("part"), F.lit(1).alias("kind"), "key", "dim", "vec", F.lit(None).cast("array<long>").alias("ids"), "bound")
        met = there.unionByName(come).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "key")
        return met.transform(in_batches, _search(k + 1, factor), "key binary, id long, d double")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("d", "id"))).where(F.col("r") <= k + 1)

    home = stored(searched(queries), "ann-home")
    bounds = home.groupBy("key").agg(F.max("d").alias("last"), F.count("*").alias("n"))
    bound = F.when(F.col("n") > k, F.col("last")).otherwise(float("inf"))
    bounded = queries.drop("bound").join(bounds, "key").select("key", "dim", "vec", "shard", bound.alias("bound"))
    visits = stored(bounded.transform(in_batches, _visits(cells, levels, factor), "key binary, dim int, vec binary, shard int, bound double"), "ann-visits")
    found = best(home.unionByName(searched(visits))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("near"))
    met = asked.withColumnRenamed("id", "query_id").join(stored(found, "ann-found").hint("merge"), "key")
    self = F.array_position(F.transform("near", lambda e: (e["d"] == 0) & (e["id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("near", lambda e, j: j != F.col("self") - 1), 1, k)
    each = met.withColumn("self", self).select("query_id", F.posexplode(others).alias("at", "e"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.d").alias("score"))

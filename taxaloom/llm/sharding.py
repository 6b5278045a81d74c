"""Minimax contiguous sharding of documents, in DataFrame operations only.

Atomic groups are the sets of rows with equal text (by SHA-256 of the UTF-8 text). Groups are laid out in the order
of their digest, so a prefix of the digest is a contiguous run of groups and sizes can be summed per prefix with a
plain aggregation. The smallest feasible shard capacity is found by binary search; a candidate capacity is checked
greedily, filling each shard as far as it goes. The driver holds per-prefix sums only: prefixes in which a cut may
still fall are refined by further digits until every such prefix is one group, so what the driver holds is bounded by
``shards`` and ``fanout`` digits, not by the number of documents.

A group larger than an even share decides the capacity by itself and would let the greedy fill leave shards empty. So the
search is repeated below it: such a group (there are fewer of them than shards) is a shard between its neighbours, in its
place in the order, and the capacity of the runs between is the smallest at which the shards that remain suffice. At that
capacity cuts are then moved towards even shares of each run. Shards are contiguous in the order throughout.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import stored

#: Hex digits of the first level, and digits by which each further level refines.
FIRST, STEP, DIGITS = 3, 2, 64
#: Rows of a shard that one task numbers (about); a group of copies is numbered by as many tasks as it needs.
NUMBERED = 250_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32 and the group's digest."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.sha2(body, 256).alias("_digest"),
    )


class _Layout:
    """Prefix sums over the digest order, refined on demand by Spark aggregations."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        rows = groups.groupBy(F.substring("_digest", 1, FIRST).alias("p")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("g")).collect()
        self._set(sorted((r["p"], r["b"], r["g"]) for r in rows))

    def _set(self, cells: list[tuple[str, int, int]]) -> None:
        self.cells, self.ends, total = cells, [], 0
        for _, size, _ in cells:
            total += size
            self.ends.append(total)
        self.total = total

    def refine(self, wanted: set[int]) -> bool:
        """Split the cells at these places that hold more than one group; False if there are none."""
        split = {self.cells[i][0] for i in wanted if self.cells[i][2] > 1}
        if not split:
            return False
        finer: dict[str, list[tuple[str, int, int]]] = {p: [] for p in split}
        for depth in sorted({len(p) for p in split}):
            these = sorted(p for p in split if len(p) == depth)
            part = self.groups.where(F.substring("_digest", 1, depth).isin(these))
            to = min(DIGITS, depth + STEP)
            rows = part.groupBy(F.substring("_digest", 1, to).alias("p")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("g")).collect()
            for r in rows:
                finer[r["p"][:depth]].append((r["p"], r["b"], r["g"]))
        self._set([y for x in self.cells for y in (sorted(finer[x[0]]) if x[0] in finer else [x])])
        return True

    def _reach(self, at: int, capacity: int, walls: list[tuple[int, int]]) -> tuple[int, bool]:
        """How far a shard from here may go, and whether it is a group that stands alone."""
        for start, end in walls:
            if start == at:
                return end, True
            if at < start < at + capacity:
                return start, False
        return at + capacity, False

    def cuts(self, capacity: int, shards: int, walls: list[tuple[int, int]] | None = None) -> list[int]:
        """Greedy check with cuts between cells only: sums of size at each shard's end. Feasible if the last is all."""
        at, out = 0, []
        for _ in range(shards):
            to, _ = self._reach(at, capacity, walls or [])
            end = bisect_right(self.ends, to)
            at = self.ends[end - 1] if end else 0
            out.append(at)
        return out

    def hopes(self, capacity: int, shards: int, walls: list[tuple[int, int]] | None = None) -> list[int]:
        """The furthest each shard's end could be if a cell of several groups could be cut anywhere."""
        at, out = 0, []
        for _ in range(shards):
            to, _ = self._reach(at, capacity, walls or [])
            end = bisect_right(self.ends, to)
            if end == len(self.cells):
                to = self.total
            elif self.cells[end][2] == 1:
                to = self.ends[end - 1] if end else 0
            at = to
            out.append(at)
        return out

    def smallest(self, walk, shards: int, low: int, high: int, walls: list[tuple[int, int]]) -> int:
        """Binary search for the smallest capacity at which this walk reaches the end."""
        while low < high:
            mid = (low + high) // 2
            if walk(mid, shards, walls)[-1] < self.total:
                low = mid + 1
            else:
                high = mid
        return low

    def span(self, digest: str) -> tuple[int, int]:
        """Where the group with this digest lies; its cell is refined until it is alone in it."""
        while True:
            k = next(k for k, (p, _, _) in enumerate(self.cells) if digest.startswith(p))
            if not self.refine({k}):
                return self.ends[k] - self.cells[k][1], self.ends[k]

    def search(self, shards: int, walls: list[tuple[int, int]]) -> int:
        """The smallest feasible capacity of shards between walls.

        The capacity that is feasible with cuts between cells bounds it from above, the one that would be feasible if cells
        could be cut anywhere from below; cells in which a cut may lie for a capacity between the two are refined until
        both are equal.
        """
        low, high = 1, max(1, self.total)
        while True:
            high = self.smallest(self.cuts, shards, low, high, walls)
            low = self.smallest(self.hopes, shards, low, high, walls)
            if low == high:
                return high
            open_cells: set[int] = set()
            for near, far in zip(self.cuts(low, shards, walls), self.hopes(high, shards, walls), strict=True):
                open_cells.update(range(bisect_right(self.ends, near), min(bisect_right(self.ends, far) + 1, len(self.cells))))
            if not self.refine(open_cells):
                return high

    def even(self, start: int, end: int, shards: int, capacity: int) -> list[int]:
        """Ends of the shards of a run, as near to even shares as this capacity and the groups allow."""
        wanted = [start + (end - start) * k // shards for k in range(1, shards)]
        while self.refine({bisect_right(self.ends, x) for x in wanted if x < self.total and x not in self.ends}):
            pass
        inner = [start, *(x for x in self.ends if start < x <= end)]
        latest, at = [], start  # the furthest ends
        for _ in range(shards):
            at = inner[bisect_right(inner, at + capacity) - 1]
            latest.append(at)
        earliest, at = [], end  # the nearest ones from which the rest can still be reached
        for _ in range(shards):
            earliest.append(at)
            at = inner[bisect_left(inner, at - capacity)] if at - capacity > start else start
        earliest.reverse()
        if any(a > b for a, b in zip(earliest, latest, strict=True)):
            return latest
        out, at = [], start
        for k, x in enumerate(wanted):
            up = min(bisect_left(inner, x), len(inner) - 1)
            best = min(inner[max(up - 1, 0)], inner[up], key=lambda y: abs(y - x))
            at = max(min(best, latest[k], inner[bisect_right(inner, at + capacity) - 1]), earliest[k], at)
            out.append(at)
        return [*out, end]


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity and the first digest prefix of every shard but the first.

    ``groups`` has a row for each group: _digest, _bytes, _rows. The capacity is exact; the cuts respect it.
    """
    layout = _Layout(groups)
    if not layout.cells:
        return 0, []
    capacity = layout.search(shards, [])
    # groups above an even share of what is left, largest first; fewer than shards
    heavy, rest = [], layout.total
    for r in groups.orderBy(F.desc("_bytes"), "_digest").limit(shards - 1).collect():
        if r["_bytes"] * (shards - len(heavy)) > rest:
            heavy.append(r["_digest"])
            rest -= r["_bytes"]
    for digest in heavy:
        layout.span(digest)
    walls = sorted(layout.span(digest) for digest in heavy)
    # walls may cut a run into more shards than there are: those that do least harm give way
    while walls and layout.cuts(capacity, shards, walls)[-1] < layout.total:
        walls.remove(min(walls, key=lambda w: w[1] - w[0]))
    inner = layout.search(shards, walls) if walls else capacity
    edges = [0, *(x for w in walls for x in w), layout.total]
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    count = []
    for a, b in runs:
        n, at = 0, a
        while at < b:
            at, n = min(b, layout.ends[bisect_right(layout.ends, at + inner) - 1]), n + 1
        count.append(n)
    for _ in range(shards - len(walls) - sum(count)):  # shards that no run needs go where shares are largest
        if runs:
            k = max(range(len(runs)), key=lambda k: (runs[k][1] - runs[k][0]) / count[k])
            count[k] += 1
    ends = [end for _, end in walls]
    for (a, b), n in zip(runs, count, strict=True):
        ends += layout.even(a, b, n, inner)
    return capacity, [layout.cells[bisect_right(layout.ends, x)][0] for x in sorted(set(ends)) if x < layout.total]


def _rank(digest: Column, starts: list[str]) -> Column:
    """How many of the (few) starts lie at or before the digest."""
    out = F.lit(0)
    for s in starts:
        out = out + (digest >= F.lit(s)).cast("int")
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard; rows with equal text share one.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 within a shard), grown_shard (null).
    Null text counts as empty; null or repeated doc_ids are kept, each row gets its own slot; an empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    rows = stored(sized(docs).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    groups = stored(rows.groupBy("_digest").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "shard-groups")
    _, starts = plan_cuts(groups, shards)
    salts = -(-rows.count() // (NUMBERED * shards)) * 4 + 1
    placed = rows.withColumn("shard", _rank(F.col("_digest"), starts).cast("int")).withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    cell = ["shard", "_s"]
    # counts by cell: a cell is about a quarter of NUMBERED rows, and no group of copies or ids is in one cell only
    before = W.partitionBy("shard").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(*cell).count().select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_n", F.row_number().over(W.partitionBy(*cell).orderBy("_row")) - 1)
    return numbered.join(offsets, cell).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_n") + F.col("_before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

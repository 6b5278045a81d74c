"""The taxonomy tree: lineages, canonical ancestors, descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import RANKS, canonical_rank, cutoff_by_world, exact_rank
from ..session import observed, stored

#: Deeper trees than this are taken to hold a cycle.
DEEPEST = 256
#: Rows of a taxonomy table below which it is broadcast; a public taxonomy has a few million nodes.
SMALL = 200_000


def sized(table: DataFrame, most: int = SMALL) -> DataFrame:
    """The table, with a broadcast hint if it has at most this many rows, else with one against it.

    Without a hint Spark goes by the bytes of files, and a taxonomy compresses well: a million nodes would be broadcast.
    """
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def normalize(ids: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """Replace merged ids in ``column`` by their successors; ``merged`` has old and new."""
    new = merged.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return ids.join(sized(new), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def known(taxids: DataFrame, nodes: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``taxids`` (taxid) -> taxid: those that are nodes or merged into one, so those that have a ``lineage``, each once."""
    at = taxids.select("taxid", F.col("taxid").alias("node")).distinct()
    if merged is not None:
        at = normalize(at, "node", merged)
    return at.join(sized(nodes.select(F.col("taxid").alias("node"))), "node", "left_semi").select("taxid").distinct()


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node, up, steps) of every node: table k leads 2^k steps up, or has a null ``up`` and the steps to the root.

    Each is the one before joined with itself, so a tree costs the logarithm of its depth. The last leads nowhere: its
    steps are the depths. A parent that is no node is none. A node that is listed with several parents has a row for each way up.
    """
    own = nodes.select(F.col("taxid").alias("node"), F.col("parent").alias("up"))
    known = own.select(F.col("node").alias("_node")).distinct()
    up = F.when(F.col("_node").isNotNull() & (F.col("up") != F.col("node")), F.col("up"))
    now = own.join(sized(known), own["up"] == known["_node"], "left").select("node", up.alias("up"), F.when(up.isNotNull(), 1).otherwise(0).alias("steps"))
    out = []
    while True:
        now, seen = observed(now, "jumps", n=F.count("*"), live=F.count("up"))
        out.append(now)
        if not seen["live"]:
            return out
        if 1 << len(out) > 2 * DEEPEST:
            raise ValueError("the taxonomy has a cycle")
        ahead = now.toDF("_node", "_up", "_steps")
        ahead = F.broadcast(ahead) if seen["n"] <= SMALL else ahead.hint("merge")
        now = now.join(ahead, now["up"] == ahead["_node"], "left").select("node", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))


def _repeated(tables: list[DataFrame]) -> DataFrame | None:
    """node, n: nodes that are listed n times, with several parents or ranks; none where each is listed once."""
    out = stored(tables[0].groupBy("node").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "repeated")
    return None if out.isEmpty() else out


def lineage(taxids: DataFrame, nodes: DataFrame, merged: DataFrame | None = None, tables: list[DataFrame] | None = None) -> DataFrame:
    """``taxids`` (taxid) -> taxid, depth, anc: ancestors of each known taxid, root at depth 0, itself last.

    Climbs from the taxids asked for: round k joins the ancestors so far with the jumps of 2^k steps, so they double, and a
    tree of 256 levels takes eight rounds. ``tables`` are the ``jumps`` of the nodes, if they are there already. Merged ids
    get the lineage of their successors; unknown ids have none. Where nodes are listed several times, every way up counts: an
    ancestor has a row for each way to it and each time it is listed, and the taxid's own depth is that of its longest way.
    """
    tables = jumps(nodes) if tables is None else tables
    at = taxids.select("taxid", F.col("taxid").alias("node")).distinct()
    if merged is not None:
        at = normalize(at, "node", merged)
    repeated = _repeated(tables)
    tops = tables[-1] if repeated is None else tables[-1].groupBy("node").agg(F.max("steps").alias("steps"))
    rows = at.join(sized(tops), "node").select("taxid", F.col("node").alias("anc"), F.col("steps").alias("depth"))
    for k, table in enumerate(tables[:-1]):
        step = table.where("up is not null").select(F.col("node").alias("anc"), "up")
        step = step.select("anc", F.array("up").alias("ups")) if repeated is None else step.groupBy("anc").agg(F.collect_list("up").alias("ups"))
        own, depth = F.struct("anc", "depth"), (F.col("depth") - (1 << k)).alias("depth")
        above = F.transform("ups", lambda up: F.struct(up.alias("anc"), depth))  # noqa: B023
        both = F.when(F.col("ups").isNull(), F.array(own)).otherwise(F.concat(F.array(own), above))
        rows = rows.join(sized(step), "anc", "left").select("taxid", F.explode(both).alias("x")).select("taxid", "x.anc", "x.depth")
    if repeated is not None:
        times = F.explode(F.array_repeat(F.lit(1), F.coalesce("n", F.lit(1))))
        rows = rows.join(sized(repeated.withColumnRenamed("node", "anc")), "anc", "left").select("taxid", "anc", "depth", times.alias("_t")).drop("_t")
    return stored(rows.select("taxid", F.col("depth").cast("int").alias("depth"), "anc"), "lineage")


#: Nodes of a stretch of the sibling order that one task adds up.
STRETCH = 1_000_000


def tour(nodes: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """taxid, first, last, depth, below, leaves, end: the interval of every node in a walk through the tree, root side first.

    A node lies below another if its ``first`` is in the other's interval and is not the other's own, so subtrees are
    comparisons (``is_below``) and no pair is listed. ``below`` counts the nodes under it, ``leaves`` those without a child;
    siblings come in the order of their taxids, several trees one after the other.

    Sizes are added up by jumps: within 2^(k+1) steps a node has what it has within 2^k, and what the nodes 2^k below it
    have. Sizes of the siblings before a node are a running sum over all nodes by (parent, taxid), less that of the first
    sibling; it is taken in stretches, so a parent with a third of all nodes is no task of its own. A node's place is the
    sum of these over its path, by jumps again. ``end`` is ``last``, but where nodes are listed with several parents (``_ways``).
    """
    tables = jumps(nodes) if tables is None else tables
    if _repeated(tables) is not None:
        return _ways(tables)
    join = lambda a, b, on, how="left": a.join(sized(b), on, how)
    inner = tables[0].where("up is not null").select(F.col("up").alias("node"), F.lit(0).alias("leaf")).distinct()
    sizes = stored(join(tables[0].select("node"), inner, "node").select("node", F.lit(1).cast("long").alias("size"), F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves")), "tour-sizes")
    for table in tables[:-1]:
        under = join(table.where("up is not null").select("node", "up"), sizes, "node").groupBy("up").agg(F.sum("size").alias("s"), F.sum("leaves").alias("l"))
        more = join(sizes, under.withColumnRenamed("up", "node"), "node")
        sizes = stored(more.select("node", (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "tour-sizes")
    own = join(tables[0].select("node", "up"), sizes, "node").select("node", "up", "size", "leaves")
    parts = -(-sizes.count() // STRETCH) or 1
    dealt = stored(own.repartitionByRange(parts, "up", "node").withColumn("part", F.spark_partition_id()), "tour-order")
    sums = dealt.groupBy("part").agg(F.sum("size").alias("s"))  # a row a stretch
    base = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("up", "node").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(base), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = stored(placed.select("node", "up", "size", "leaves", "before"), "tour-placed")
    starts = placed.groupBy("up").agg(F.min("before").alias("start")).withColumnRenamed("up", "_up")
    place = placed.join(sized(starts), F.col("up").eqNullSafe(F.col("_up"))).select("node", (F.col("before") - F.col("start") + 1).alias("first"))
    place = stored(place, "tour-place")
    for table in tables[:-1]:
        ahead = place.select(F.col("node").alias("up"), F.col("first").alias("more"))
        met = join(join(place, table.select("node", "up"), "node"), ahead, "up")
        place = stored(met.select("node", (F.col("first") + F.coalesce("more", F.lit(0))).alias("first")), "tour-place")
    out = join(join(placed.select("node", "size", "leaves"), place, "node"), tables[-1].select("node", F.col("steps").alias("depth")), "node")
    leaves = F.when(F.col("size") > 1, F.col("leaves")).otherwise(0)
    last = F.col("first") + F.col("size") - 1
    return stored(out.select(F.col("node").alias("taxid"), "first", last.alias("last"), "depth", (F.col("size") - 1).alias("below"), leaves.alias("leaves"), last.alias("end")), "tour")


def counts(nodes: DataFrame) -> DataFrame:
    """taxid, below, leaves: distinct nodes under every node that has any, and those of them without a child.

    By the ``tour`` where each node is listed with one parent. Else by pairs (node, ancestor), each once, that double their
    reach until no pair is new: that lists no ways, which multiply, and ends on a cycle, whose nodes lie below one another.
    A node without a child and with one parent is in no pair: it counts with its parent, for all that the parent is below.
    """
    known = nodes.select(F.col("taxid").alias("up")).distinct()
    edges = nodes.where("parent <> taxid").select(F.col("taxid").alias("node"), F.col("parent").alias("up")).distinct()
    edges = stored(edges.join(sized(known), "up", "left_semi").select("node", "up"), "edges")
    parents = stored(edges.groupBy("node").agg(F.count("*").alias("n"), F.min("up").alias("up")), "parents")
    if parents.where("n > 1").isEmpty():
        return tour(nodes).where("below > 0").select("taxid", "below", "leaves").distinct()
    inner = stored(edges.select(F.col("up").alias("node")).distinct(), "inner")
    ends = parents.join(sized(inner), "node", "left_anti")
    single = stored(ends.where("n = 1").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("c")), "ends")
    pairs = edges.join(sized(inner), "node", "left_semi").select("node", F.col("up").alias("anc"))
    pairs, seen = observed(pairs, "pairs", n=F.count("*"))
    while True:
        further = pairs.toDF("anc", "_anc").hint("merge")
        pairs, now = observed(pairs.unionByName(pairs.join(further, "anc").select("node", F.col("_anc").alias("anc"))).distinct(), "pairs", n=F.count("*"))
        if now["n"] == seen["n"]:
            break
        seen = now
    many = edges.join(sized(ends.where("n > 1").select("node")), "node", "left_semi")
    above = many.join(pairs.toDF("up", "anc").hint("merge"), "up").select("node", "anc")
    one = F.lit(1).cast("long")
    each = pairs.where("node <> anc").select("anc", one.alias("below"), F.lit(0).cast("long").alias("leaves"))
    each = each.unionByName(many.select("node", F.col("up").alias("anc")).unionByName(above).distinct().select("anc", one.alias("below"), one.alias("leaves")))
    # a node on a cycle has itself above, and its own ends count once
    under = pairs.where("node <> anc").unionByName(inner.select("node", F.col("node").alias("anc"))).join(sized(single), "node")
    each = each.unionByName(under.select("anc", F.col("c").alias("below"), F.col("c").alias("leaves")))
    return each.groupBy(F.col("anc").alias("taxid")).agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))


def _ways(tables: list[DataFrame]) -> DataFrame:
    """The ``tour`` where nodes are listed with several parents: a row for every way from a root to a node.

    ``first`` is the place of the way among all, by the taxids on it. ``below`` and ``leaves`` count distinct nodes, and
    ``last`` is ``first`` and ``below``; the ways that lead on from here take the places up to ``end``. Every row of a node has
    as many, so one of them is enough to find what lies below.
    """
    ways = tables[0].select("node", "up", F.array("node").alias("path"))
    for _ in tables[1:]:
        ahead = sized(ways.toDF("_node", "_up", "_path"))
        met = ways.join(ahead, F.col("up") == F.col("_node"), "left")
        ways = stored(met.select("node", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")), "tour-ways")
    parts = -(-ways.count() // STRETCH) or 1
    dealt = stored(ways.select("node", "path").repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "tour-order")
    sums = dealt.groupBy("part").agg(F.count("*").alias("s"))  # a row a stretch
    base = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("path"))
    placed = dealt.join(F.broadcast(base), "part").select("node", first.alias("first"), (F.size("path") - 1).alias("depth"))
    inner = tables[0].where("up is not null").select(F.col("up").alias("node"), F.lit(0).alias("leaf")).distinct()
    under = ways.select("node", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("anc")).groupBy("anc", "node").agg(F.count("*").alias("c"))
    under = under.join(sized(inner), "node", "left").groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("below"), F.sum(F.coalesce("leaf", F.lit(1))).alias("leaves"), F.sum("c").alias("under"))
    times = ways.groupBy("node").agg(F.count("*").alias("times"))
    counts = stored(times.join(under.hint("merge"), "node", "left").select("node", "times", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "leaves", "under"))), "tour-sizes")
    ahead = (F.col("first") + F.col("below")).alias("last"), "depth", "below", "leaves", (F.col("first") + F.expr("under div times")).alias("end")
    return stored(placed.join(sized(counts), "node").select(F.col("node").alias("taxid"), "first", *ahead), "tour")


def is_below(node: Column, first: Column, end: Column) -> Column:
    """Whether the ``first`` of a node lies in the interval (to its ``end``) of another, below it."""
    return (node > first) & (node <= end)


def described(taxids: DataFrame, lineages: DataFrame, nodes: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``taxids`` (taxid) -> taxid, rank, path: an unknown taxid has rank no_rank; of several ranks the first counts.

    The rank is that of the node, with ``merged`` of the successor; the path is empty where ``lineages`` has none. A taxid
    that is listed several times has every entry of its path once for each.
    """
    ids = taxids.select("taxid", F.col("taxid").alias("_node")).distinct()
    if merged is not None:
        ids = normalize(ids, "_node", merged)
    ranks = nodes.groupBy(F.col("taxid").alias("_node")).agg(F.min("rank").alias("rank"), F.count("*").cast("int").alias("times"))
    out = ids.join(paths(lineages).hint("merge"), "taxid", "left").join(sized(ranks), "_node", "left")
    path = F.when(F.col("times") > 1, F.flatten(F.transform("path", lambda x: F.array_repeat(x, F.col("times"))))).otherwise(F.col("path"))
    return out.select("taxid", F.coalesce("rank", F.lit("no_rank")).alias("rank"), F.coalesce(path, F.array().cast("array<bigint>")).alias("path"))


def exclusions(samples: DataFrame, canon: DataFrame, excluded: DataFrame) -> DataFrame:
    """``samples`` (id, world, taxon) -> id, world, cutoff, index, is_excluded, level: how deep each may be called.

    ``excluded`` (level, taxid) lists the species, genera and families that are left out of the reference; a sample is met
    by its canonical ancestor at the level. Ancestors that are missing are not excluded; a listed pair may be repeated.
    """
    out = samples.join(sized(canon.select(F.col("taxid").alias("taxon"), "species", "genus", "family")), "taxon", "left")
    for level in ("species", "genus", "family"):
        listed = excluded.where(F.col("level") == level).select(F.col("taxid").alias(level), F.lit(True).alias(f"{level}_out")).distinct()
        out = out.join(sized(listed), level, "left")
    return out.select("id", "world", cutoff_by_world(F.col("world"), *(F.col(f"{x}_out") for x in ("species", "genus", "family"))).alias("c")).select("id", "world", "c.*")


def canonical(lineages: DataFrame, nodes: DataFrame) -> DataFrame:
    """taxid with a column for each canonical rank: the ancestor nearest the root whose rank is read as that one, the smaller of two."""
    ranked = lineages.join(sized(nodes.select(F.col("taxid").alias("anc"), canonical_rank(F.col("rank")).alias("rank"))), "anc")
    return ranked.groupBy("taxid").agg(*(F.min(F.when(F.col("rank") == r, F.struct("depth", "anc")))["anc"].alias(r) for r in RANKS))


def output_ancestors(lineages: DataFrame, nodes: DataFrame) -> DataFrame:
    """taxid with a column for each canonical rank: the deepest ancestor of exactly that rank, as output calls use it, the larger of two."""
    ranked = lineages.join(sized(nodes.select(F.col("taxid").alias("anc"), exact_rank(F.col("rank")).alias("rank"))), "anc")
    return ranked.groupBy("taxid").agg(*(F.max(F.when(F.col("rank") == r, F.struct("depth", "anc")))["anc"].alias(r) for r in RANKS))


def descendants(taxids: DataFrame, tour: DataFrame, leaves_only: bool = True, merged: DataFrame | None = None) -> DataFrame:
    """``taxids`` (taxid) and the ``tour`` of the tree -> taxid, descendant; with ``leaves_only`` those without a child.

    Places of the walk are dense, so the interval of a taxid is listed and met with the nodes by equality: the work is that
    of the result, a pair once. With ``merged`` old ids are listed beside their successors.
    """
    one = tour.where("below > 0").groupBy("taxid").agg(F.min(F.struct("first", "end")).alias("one"))
    inside = taxids.select("taxid").distinct().join(sized(one), "taxid")
    listed = inside.select("taxid", F.explode(F.sequence(F.col("one.first") + 1, F.col("one.end"))).alias("first"))
    own = tour.where("below = 0") if leaves_only else tour
    out = listed.join(sized(own.select("first", F.col("taxid").alias("descendant"))), "first").select("taxid", "descendant").distinct()
    if merged is not None:
        old = out.join(sized(merged.select(F.col("new").alias("descendant"), "old")), "descendant").select("taxid", F.col("old").alias("descendant"))
        out = out.unionByName(old)
    return out


def paths(lineages: DataFrame) -> DataFrame:
    """taxid, path: the lineage as an array, root first."""
    return lineages.groupBy("taxid").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "anc"))), lambda x: x["anc"]).alias("path"))

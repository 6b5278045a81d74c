"""Operators on small inputs with known results, and against plain loops."""

import json
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxaloom.functions import ranks, tokens
from taxaloom.functions.ranks import RANKS
from taxaloom.operators import bins, calibration, candidates, features, metrics, order, residual, sampling, scoring, selection, taxonomy, tensors

NODES = [(1, 1, "no rank"), (2, 1, "superkingdom"), (10, 2, "phylum"), (20, 10, "class"), (30, 20, "order"), (40, 30, "family"), (50, 40, "genus"), (60, 50, "species"), (61, 50, "species")]


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame(NODES, "taxid long, parent long, rank string")
    merged = spark.createDataFrame([(600, 60)], "old long, new long")
    return nodes, merged, taxonomy.lineage(spark.createDataFrame([(60,), (61,), (10,), (600,), (999,)], "taxid long"), nodes, merged)


def test_tokens(spark):
    rows = [("60:5 A:3 61:2 0:4", 3), (None, 0), ("  x 7:1  ", 1), ("99999999999999999999:1", 1)]
    frame = spark.createDataFrame([(k,) for k, _ in rows], "kmers string")
    got = frame.select(tokens.numeric_tokens(F.col("kmers")).alias("t"), tokens.parse_kmers(F.col("kmers")).alias("p")).collect()
    assert [len(r["t"]) for r in got] == [n for _, n in rows]
    assert got[0]["p"] == ["60:5", "A:3", "61:2", "0:4"] and got[1]["p"] == [] and got[3]["t"][0]["taxid"] is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("Name (taxid 562)", 562), ("(9)", 9), ("17", 17), ("no number", None), (None, None)],
)
def test_taxid(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tokens.taxid_of(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("rank", "want"),
    [("kingdom", "superkingdom"), ("Domain", "superkingdom"), ("suborder", "order"), ("superclass", "class"), ("strain", "strain"), ("clade", None), ("no rank", None), (None, None), ("subspecies", "species"), ("subkingdom", "superkingdom"), ("infrakingdom", "superkingdom"), ("superkingdom", "superkingdom"), ("subdomain", "superkingdom")],
)
def test_canonical_rank(spark, rank, want):
    assert spark.createDataFrame([(rank,)], "r string").select(ranks.canonical_rank(F.col("r"))).first()[0] == want


def test_accession(spark):
    got = spark.createDataFrame([("GCF_1.12_x7/1",), ("NC_5.1a/2",)], "n string").select(tokens.accession(F.col("n"))).collect()
    assert [r[0] for r in got] == ["GCF_1.1", "NC_5.1"]


def test_bins_split_runs(spark):
    reads = spark.createDataFrame([("a", "60:25 A:9 0:3"), ("b", "61:0 60:4")], "id string, kmers string")
    placed = bins.positions(bins.runs(reads))
    got = sorted(map(tuple, bins.bins(placed, 10).collect()))
    assert got == [("a", 0, 60, 10), ("a", 1, 60, 10), ("a", 2, 0, 3), ("a", 2, 60, 5), ("b", 0, 60, 4)]


@pytest.mark.parametrize("most", [1, 3, 7])
def test_downsample(spark, most):
    frame = spark.createDataFrame([("r", b, 1, 1) for b in range(0, 22, 2)], "id string, bin long, taxid long, cnt long")
    want = list(range(0, 22, 2)) if most >= 11 else [2 * int(i * 11 / most) for i in range(most)]
    assert sorted(r["bin"] for r in bins.downsample(frame, most).collect()) == want


def test_lineage(spark, tree):
    nodes, merged, lineage = tree
    paths = {r["taxid"]: r["path"] for r in taxonomy.paths(lineage).collect()}
    assert paths[60] == paths[600] == [1, 2, 10, 20, 30, 40, 50, 60] and paths[10] == [1, 2, 10] and 999 not in paths
    canon = {r["taxid"]: r for r in taxonomy.canonical(lineage, nodes).collect()}
    assert canon[61]["genus"] == 50 and canon[10]["species"] is None
    tour, asked = taxonomy.tour(nodes), spark.createDataFrame([(50,), (60,), (999,)], "taxid long")
    assert {tuple(r) for r in taxonomy.descendants(asked, tour, merged=merged).collect()} == {(50, 60), (50, 61), (50, 600)}


def test_described_taxids_listed_twice_and_merged_without_a_lineage(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "genus"), (5, 2, "species"), (5, 2, "genus")], "taxid long, parent long, rank string")
    merged = spark.createDataFrame([(90, 5), (91, 2)], "old long, new long")
    ids, asked = (spark.createDataFrame([(k,) for k in x], "taxid long") for x in ((2, 5, 90), (2, 5, 7, 90, 91)))
    got = {r["taxid"]: (r["rank"], r["path"]) for r in taxonomy.described(asked, taxonomy.lineage(ids, nodes, merged), nodes, merged).collect()}
    twice = ("genus", [1] * 4 + [2] * 4 + [5] * 4)
    assert got == {2: ("genus", [1, 2]), 5: twice, 90: twice, 7: ("no_rank", []), 91: ("genus", [])}


@pytest.mark.parametrize("small", [200_000, 0])
def test_lineages_and_tours_of_random_forests(spark, monkeypatch, small):
    monkeypatch.setattr(taxonomy, "SMALL", small)
    monkeypatch.setattr(taxonomy.sized, "__defaults__", (small,))
    monkeypatch.setattr(taxonomy, "STRETCH", 17)
    draw = random.Random(2)
    parent = {k: draw.choice([None, k, 9999]) if k % 40 == 0 else (draw.randrange(k) if k % 3 else k // 40 * 40) for k in range(1, 150)}
    parent[1], parent[2] = 1, 1
    parent = {k: 1 if p == 0 else p for k, p in parent.items()}
    nodes = spark.createDataFrame(list(parent.items()), "taxid long, parent long")

    def path(k):
        out = [k]
        while parent[k] in parent and parent[k] != k:
            k = parent[k]
            out.insert(0, k)
        return out

    want = {k: path(k) for k in parent}
    got = {r["taxid"]: r["path"] for r in taxonomy.paths(taxonomy.lineage(nodes.select("taxid"), nodes)).collect()}
    assert got == want
    walk = {r["taxid"]: r for r in taxonomy.tour(nodes).collect()}
    assert sorted(r["first"] for r in walk.values()) == list(range(1, len(parent) + 1))
    under = {k: {j for j in parent if k in want[j][:-1]} for k in parent}
    for k, r in walk.items():
        assert {j for j in parent if r["first"] < walk[j]["first"] <= r["last"]} == under[k]
        assert (r["depth"], r["below"], r["leaves"]) == (len(want[k]) - 1, len(under[k]), sum(not under[j] for j in under[k]))
    assert sorted(want, key=lambda k: walk[k]["first"]) == sorted(want, key=lambda k: want[k])
    pairs = {tuple(r) for r in taxonomy.descendants(nodes.select("taxid"), taxonomy.tour(nodes), leaves_only=False).collect()}
    assert pairs == {(k, j) for k in parent for j in under[k]}


@pytest.mark.parametrize("small", [200_000, 0])
def test_a_node_listed_with_two_parents(spark, monkeypatch, small):
    monkeypatch.setattr(taxonomy, "SMALL", small)
    monkeypatch.setattr(taxonomy.sized, "__defaults__", (small,))
    monkeypatch.setattr(taxonomy, "STRETCH", 3)
    rows = [(1, 1, "no rank"), (2, 1, "family"), (3, 2, "genus"), (3, 1, "species"), (4, 3, "species"), (5, 4, "strain"), (6, 2, "genus")]
    nodes = spark.createDataFrame(rows, "taxid long, parent long, rank string")
    got = taxonomy.lineage(spark.createDataFrame([(5,), (6,)], "taxid long"), nodes).collect()
    want = []
    for taxid in (5, 6):
        ways = [[r] for r in rows if r[0] == taxid]  # every way up over the rows, once for each row that it ends in
        for way in ways:
            ways += [[*way, r] for r in rows if r[0] == way[-1][1] != way[-1][0]]
        want += [(taxid, max(map(len, ways)) - len(way), way[-1][0]) for way in ways]
    assert sorted((r["taxid"], r["depth"], r["anc"]) for r in got) == sorted(want)
    tour = taxonomy.tour(nodes)
    assert [tuple(r) for r in tour.orderBy("first").collect()] == [
        (1, 1, 6, 0, 5, 2, 9), (2, 2, 6, 1, 4, 2, 6), (3, 3, 5, 2, 2, 1, 5), (4, 4, 5, 3, 1, 1, 5), (5, 5, 5, 4, 0, 0, 5), (6, 6, 6, 2, 0, 0, 6), (3, 7, 9, 1, 2, 1, 9), (4, 8, 9, 2, 1, 1, 9), (5, 9, 9, 3, 0, 0, 9),
    ]
    under = taxonomy.descendants(nodes.select("taxid"), tour, leaves_only=False).collect()
    assert sorted(map(tuple, under)) == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 3), (2, 4), (2, 5), (2, 6), (3, 4), (3, 5), (4, 5)]


@pytest.mark.parametrize("small", [200_000, 0])
@pytest.mark.parametrize("cycle", [False, True])
def test_counts_of_nodes_listed_with_several_parents(spark, monkeypatch, small, cycle):
    """Distinct nodes below, also where ways lead round in a cycle."""
    monkeypatch.setattr(taxonomy, "SMALL", small)
    monkeypatch.setattr(taxonomy.sized, "__defaults__", (small,))
    draw = random.Random(5)
    rows = {(1, 1)} | {(k, draw.randrange(max(1, k // 5), k)) for k in range(2, 60) for _ in range(draw.choice((1, 1, 2, 3)))} | {(70, 999)}
    rows |= {(4, 20), (20, 9), (9, 4), (2, 2)} if cycle else set()
    edges = {(a, b) for a, b in rows if a != b and b != 999}
    below = set(edges)
    while more := {(a, d) for a, b in below for c, d in edges if b == c} - below:
        below |= more
    inner = {b for _, b in edges}
    want = {b: (sum(y == b != x for x, y in below), sum(y == b != x and x not in inner for x, y in below)) for _, b in below}
    got = taxonomy.counts(spark.createDataFrame(sorted(rows), "taxid long, parent long")).collect()
    assert {r["taxid"]: (r["below"], r["leaves"]) for r in got} == want and len(got) == len(want)


def test_a_large_table_is_not_broadcast_for_its_small_files(spark):
    table = spark.range(100).selectExpr("id", "id AS v")
    plan = spark.range(1000).join(taxonomy.sized(table, 10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_known_taxa_are_those_with_a_lineage(spark, tree):
    nodes, merged, lineage = tree
    asked = spark.createDataFrame([(60,), (61,), (10,), (600,), (999,), (60,), (None,)], "taxid long")
    for listed in (nodes, nodes.union(spark.createDataFrame([(60, 30, "species")], nodes.schema))):
        got = [r["taxid"] for r in taxonomy.known(asked, listed, merged).collect()]
        assert sorted(got) == [10, 60, 61, 600] == sorted(r["taxid"] for r in taxonomy.lineage(asked, listed, merged).select("taxid").distinct().collect())
    assert [r["taxid"] for r in taxonomy.known(asked, nodes).orderBy("taxid").collect()] == [10, 60, 61]


def test_a_chain_takes_few_rounds(spark):
    nodes = spark.range(1, 202).selectExpr("id AS taxid", "greatest(id - 1, 1) AS parent")
    tables = taxonomy.jumps(nodes)
    assert len(tables) <= 9
    (path,) = taxonomy.paths(taxonomy.lineage(spark.createDataFrame([(201,)], "taxid long"), nodes, tables=tables)).collect()
    assert path["path"] == list(range(1, 202))


def test_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 2, "x"), (2, 1, "x")], "taxid long, parent long, rank string")
    with pytest.raises(ValueError):
        taxonomy.lineage(spark.createDataFrame([(1,)], "taxid long"), nodes)


def test_candidates_and_labels(spark, tree):
    nodes, merged, lineage = tree
    reads = spark.createDataFrame([("a", "61:3 60:5 999:9 600:3 0:50")], "id string, kmers string")
    got = candidates.candidates(bins.runs(reads), lineage.select("taxid"), merged).orderBy("pos").collect()
    assert [(r["taxid"], r["taxon"]) for r in got] == [(60, 60), (61, 61), (600, 60)]
    pairs = spark.createDataFrame([("a", 60, 61), ("a", 10, 61)], "id string, taxon long, true_taxon long")
    labels = {r["taxon"]: [r[f"label_{x}"] for x in RANKS] for r in candidates.labels(pairs, taxonomy.canonical(lineage, nodes)).collect()}
    assert labels == {60: [1] * 6 + [0], 10: [1, 1, 0, 0, 0, 0, 0]}
    chosen = candidates.training_candidates(candidates.ranked(bins.runs(reads)), spark.createDataFrame([("a", 600)], "id string, taxid long"), 1, 1).collect()
    assert {r["why"] for r in chosen} <= {"top", "extra", "reported"} and 600 in {r["taxid"] for r in chosen}
    support = candidates.ranked(bins.runs(spark.createDataFrame([("a", "1:9 2:8 3:7 4:2 5:1"), ("b", "1:3 2:1")], "id string, kmers string")))
    said = spark.createDataFrame([("a", 5), ("b", 2)], "id string, taxid long")
    for top, extra, want in ((1, 1, 3), (None, 0, 4), (2, 9, 4), (1, 0, 2)):  # the reported one besides; b has no support of 5
        got = candidates.training_candidates(support, said, top, extra, least=5).collect()
        assert {r["id"] for r in got} == {"a"} and len(got) == want and {r["taxid"] for r in got} <= {1, 2, 3, 5}, (top, extra)
        assert {r["taxid"]: r["why"] for r in got}[5] == "reported"


def test_features(spark, tree):
    nodes, _, lineage = tree
    canon = taxonomy.canonical(lineage, nodes)
    binned = spark.createDataFrame([("a", 0, 60, 5), ("a", 0, 61, 3), ("a", 1, 60, 10), ("a", 1, 0, 10)], "id string, bin long, taxid long, cnt long")
    pairs = spark.createDataFrame([("a", 60, 60)], "id string, taxid long, taxon long")
    got = {r["bin"]: r for r in features.bin_features(binned, pairs, canon, nodes).collect()}
    assert got[0]["exact"] == 0.625 and (got[0]["species_in"], got[0]["species_out"], got[0]["species_desc"]) == (0.625, 0.375, 0)
    assert (got[0]["genus_in"], got[0]["genus_out"], got[0]["genus_desc"]) == (0, 0, 1)
    assert (got[1]["exact"], got[1]["species_in"], got[1]["species_out"]) == (0.5, 0.5, 0.5)
    assert all(math.isclose(r[f"{x}_in"] + r[f"{x}_out"] + r[f"{x}_desc"], 1) for r in got.values() for x in RANKS)
    rows = features.feature_rows(features.bin_features(binned, pairs, canon, nodes)).collect()
    assert len(rows) == 1 and [len(b) for b in rows[0]["bins"]] == [22, 22]


def test_features_of_a_taxid_listed_twice(spark):
    """K-mers count once for each listing, shares add up to one, and no shuffle is as wide as the features."""
    nodes = spark.createDataFrame([*NODES, (61, 40, "genus")], "taxid long, parent long, rank string")
    canon = spark.createDataFrame([(60, 2, 10, 20, 30, 40, 50, 60), (61, 2, 10, 20, 30, 40, 50, 61)], f"taxid long, {', '.join(f'{r} long' for r in RANKS)}")
    binned = spark.createDataFrame([("a", 0, 60, 4), ("a", 0, 61, 3), ("a", 0, 0, 2)], "id string, bin long, taxid long, cnt long")
    pairs = spark.createDataFrame([("a", 60, 60), ("a", 61, 61), ("a", 600, 60)], "id string, taxid long, taxon long")
    rows = features.bin_features(binned, pairs, canon, nodes)
    got = {r["taxon"]: r for r in rows.collect()}
    assert rows.count() == 2 and (got[60]["exact"], got[61]["exact"]) == (4 / 12, 6 / 12)
    assert (got[60]["genus_in"], got[60]["genus_out"], got[60]["genus_desc"]) == (3 / 12, 2 / 12, 7 / 12)
    assert (got[61]["species_in"], got[61]["species_out"], got[61]["species_desc"]) == (6 / 12, 6 / 12, 0)
    plan = features.feature_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any("genus_in" in x or "tot6" in x for x in plan.splitlines() if " Exchange " in x) and plan.count("REPARTITION_BY_COL") == 1


def plain_choice(rows, limit, tie_break):
    """The selection rule as a loop."""
    clean = [[x if x is not None and math.isfinite(x) else None for x in r] for r in rows]
    some = [k for k, r in enumerate(clean) if any(x is not None for x in r)]
    if not some:
        return 0, None
    top = [max((clean[k][r] for k in some if clean[k][r] is not None), default=None) for r in range(7)]
    good = [r for r in range(7) if top[r] is not None and top[r] >= limit] or [r for r in range(7) if top[r] is not None]
    r = good[-1]
    near = lambda a, b: abs(a - b) <= 1e-15 + 1e-12 * abs(b)
    ties = [k for k in some if clean[k][r] is not None and near(clean[k][r], top[r])]
    parts = {"p_only": [], "sum_to_rank": [range(r + 1)], "deep_then_sum": [range(r + 1), range(r + 1, 7)]}[tie_break]
    for part in parts:
        sums = {k: sum(clean[k][x] or 0 for x in part) for k in ties}
        ties = [k for k in ties if near(sums[k], max(sums.values()))]
    return ties[0], RANKS[r]


@pytest.mark.parametrize("tie_break", selection.TIE_BREAKS)
def test_selection_is_the_loop(spark, tie_break):
    draw = random.Random(7)
    pick = lambda: draw.choice([None, 0.1, 0.3, 0.5, 0.5 + 1e-14, 0.9, float("nan"), float("inf")])
    reads = {f"r{k}": [[pick() for _ in range(7)] for _ in range(draw.randint(1, 5))] for k in range(150)}
    reads["none"] = [[None] * 7] * 2
    rows = [(i, p, p, False, *map(lambda x: x, r)) for i, own in reads.items() for p, r in enumerate(own)]
    frame = spark.createDataFrame(rows, "id string, pos int, taxon long, in_lineage boolean, " + ", ".join(f"prob_{r} double" for r in RANKS))
    got = {r["id"]: (r["pos"], r["chosen_rank"]) for r in selection.select_calls(frame, 0.5, tie_break).collect()}
    assert got == {i: plain_choice(own, 0.5, tie_break) for i, own in reads.items()}


def test_back_off(spark):
    calls = spark.createDataFrame([("a", 60, "genus"), ("b", 60, "class"), ("c", 60, None)], "id string, taxon long, chosen_rank string")
    own = spark.createDataFrame([(60, 50)], "taxid long, genus long").withColumns({r: F.lit(None).cast("long") for r in RANKS if r != "genus"})
    assert {r["id"]: r["final_taxid"] for r in selection.back_off(calls, own).collect()} == {"a": 50, "b": 60, "c": None}


@pytest.mark.parametrize(("scores", "ys", "want"), [([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], 1.0), ([0.1, 0.2, 0.8, 0.9], [1, 1, 0, 0], 0.0), ([0.5, 0.6], [1, 1], 0.5)])
def test_auroc(spark, scores, ys, want):
    frame = spark.createDataFrame([("h", s, y, k) for k, (s, y) in enumerate(zip(scores, ys, strict=True))], "head string, score double, y int, pos long")
    assert metrics.auroc(frame, ["head"]).first()["auroc"] == want == metrics.auroc(frame, ["head"], ties="merged").first()["auroc"]


def test_losses(spark):
    frame = spark.createDataFrame([(20.0, 1.0), (-20.0, 0.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    perfect, hidden = frame.agg(metrics.masked_mean(metrics.focal(x, y), F.lit(True)), metrics.masked_mean(metrics.focal(x, y), F.lit(False))).first()
    assert perfect < 1e-4 and hidden == 0


def test_lineage_focal_is_the_loop(spark):
    draw = random.Random(3)
    rows = [([draw.uniform(-3, 3) for _ in range(7)], [draw.choice([-1, 0, 1]) for _ in range(7)]) for _ in range(40)]
    got = spark.createDataFrame(rows, "x array<double>, y array<int>").agg(metrics.lineage_focal(F.col("x"), F.col("y"))).first()[0]
    sig = lambda v: 1 / (1 + math.exp(-v))
    loss = [(0.25 if y else 0.75) * (1 - (sig(x) if y else 1 - sig(x))) ** 2 * -math.log(sig(x) if y else 1 - sig(x)) for xs, ys in rows for x, y in zip(xs, ys, strict=True) if y >= 0]
    pen = [max(0, sig(xs[k + 1]) - sig(xs[k])) ** 2 for xs, ys in rows for k in range(6) if min(ys[k], ys[k + 1]) >= 0]
    assert math.isclose(got, sum(loss) / len(loss) + 0.5 * sum(pen) / len(pen), rel_tol=1e-9)
    assert spark.createDataFrame([([1.0] * 7, [-1] * 7)], "x array<double>, y array<int>").agg(metrics.lineage_focal(F.col("x"), F.col("y"))).first()[0] == 0


@pytest.mark.parametrize("per", [7, 200, 10**6])
def test_curves_over_ranges(spark, monkeypatch, per):
    monkeypatch.setattr(order, "PER", per)
    draw = random.Random(4)
    rows = [(h, draw.choice([0.1, 0.5, draw.random()]), draw.randint(0, 1), k) for h in "ab" for k in range(150)]
    frame = spark.createDataFrame([*rows, ("c", 0.5, 1, 0)], "head string, score double, y int, pos long")
    got = {r["head"]: r["auroc"] for r in metrics.auroc(frame, ["head"], ties="merged").collect()}
    areas = {r["head"]: r["aupr"] for r in metrics.aupr(frame, ["head"]).collect()}
    for h in "ab":
        pos, neg = ([s for g, s, y, _ in rows if g == h and y == v] for v in (1, 0))
        assert math.isclose(got[h], sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
        area, last, tp = 0.0, (0.0, 1.0), 0
        for k, (_, _, y, _) in enumerate(sorted((r for r in rows if r[0] == h), key=lambda r: (-r[1], r[3])), 1):
            tp += y
            now = (tp / len(pos), tp / k)
            area, last = area + (now[0] - last[0]) * (now[1] + last[1]) / 2, now
        assert math.isclose(areas[h], area)
    assert got["c"] == 0.5 and areas["c"] == 1


def test_short_floats(spark):
    values = [0.0, 1.0, 1 / 3, 0.1, -2.7, 65504.0, 65519.0, 70000.0, 6e-8, 5e-5, 2**-14, 1e30, 1023.5, 2049.0, 2051.0]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    half = [r[0] for r in frame.select(tensors.to_dtype(F.col("v"), "fp16")).collect()]
    assert half == [float(np.float16(v)) for v in values]
    brain = [r[0] for r in frame.select(tensors.to_dtype(F.col("v"), "bf16")).collect()]
    bits = np.array(values, np.float32).view(np.uint32).astype(np.uint64)
    want = (((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)
    assert brain == want.astype(float).tolist()


def test_masked_bins(spark):
    frame = spark.createDataFrame([(k, [[1.0, 2.0]] * 50) for k in range(40)], "id long, bins array<array<float>>")
    got = [r[0] for r in frame.select(sampling.mask_bins(F.col("bins"), 1, F.col("id"), 0.2)).collect()]
    gone = sum(b == [0, 0] for row in got for b in row)
    assert 300 < gone < 500 and all(b in ([0, 0], [1, 2]) for row in got for b in row)
    assert got == [r[0] for r in frame.select(sampling.mask_bins(F.col("bins"), 1, F.col("id"), 0.2)).collect()]


def test_tensor_shapes(spark):
    got = spark.range(1).select(
        tensors.resample(F.array(*map(F.lit, [0.0, 1.0, 4.0])), 5).alias("a"), tensors.resample(F.array(F.lit(2.0)), 3).alias("b"),
        tensors.crop(F.sequence(F.lit(0), F.lit(9)), F.lit(2), 5).alias("c"), tensors.masked_mean(F.array(*map(F.lit, [1.0, 2.0, 3.0])), F.array(*map(F.lit, [1.0, 0.0, 1.0]))).alias("d"),
        tensors.mask(F.lit(3), F.lit(5)).alias("e"),
    ).first()
    assert got["a"] == [0, 0.5, 1, 2.5, 4] and got["b"] == [2, 2, 2] and got["c"] == [2, 3, 4, 5, 6] and got["d"] == 2 and got["e"] == [1, 1, 1, 0, 0]


def test_batches(spark):
    rows = spark.createDataFrame([(0, k) for k in range(5)] + [(1, k) for k in range(3)], "shard int, row long")
    sizes = lambda **kw: sorted(tuple(r) for r in sampling.batches(rows, 2, **kw).groupBy("shard", "batch").count().collect())
    assert sizes() == [(0, 0, 2), (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 1, 1)]
    assert sizes(drop_last=True) == [(0, 0, 2), (0, 1, 2), (1, 0, 2)]
    shards = spark.createDataFrame([(0, 3), (1, 2)], "shard int, n long")
    assert [tuple(r) for r in sampling.offsets(shards).orderBy("shard").collect()] == [(0, 3, 0), (1, 2, 3)]
    assert sorted(tuple(r) for r in sampling.locate(spark.createDataFrame([(2,), (3,)], "i long"), sampling.offsets(shards)).collect()) == [(2, 0, 2), (3, 1, 0)]
    uneven = spark.createDataFrame([(9_999, 7), (10_000, 0), (10_001, 1), (25_000, 12)], "shard int, n long")
    assert [r["first"] for r in sampling.offsets(uneven).orderBy("shard").collect()] == [0, 7, 7, 8]
    assert [tuple(r)[1:] for r in sampling.locate(spark.range(20).toDF("i"), sampling.offsets(uneven)).orderBy("i").collect()] == [*((9_999, k) for k in range(7)), (10_001, 0), *((25_000, k) for k in range(12))]
    many = spark.createDataFrame([(k, 1) for k in range(30)], "shard int, n long")
    turns = lambda epoch: [r["shard"] for r in sampling.epoch_shards(many, 1, epoch).orderBy("turn").collect()]
    assert turns(1) == turns(1) != turns(2)


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=20))
def test_pava_is_the_minmax_formula(points):
    xs = sorted({x for x, _ in points})
    s = [sum(y for x, y in points if x == k) for k in xs]
    n = [sum(1 for x, _ in points if x == k) for k in xs]
    x, y = calibration.pava(np.array(xs, float), np.array(s) / np.array(n), np.array(n, float))
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    want = [max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))]
    assert np.allclose(np.interp(xs, x, y), want)


@pytest.mark.parametrize("per", [7, 200, 10**6])
def test_isotonic_fit_over_ranges(spark, monkeypatch, per):
    monkeypatch.setattr(order, "PER", per)
    draw = random.Random(8)
    rows = [("h", draw.choice([draw.random(), 0.25, 0.25 + 1e-9]), draw.randint(0, 1)) for _ in range(400)]
    got = sorted((r["x"], r["y"]) for r in calibration.fit(spark.createDataFrame([*rows, ("i", 0.5, 1), ("i", None, 0)], "head string, score double, y int")).where("head = 'h'").collect())
    xs = sorted({x for _, x, _ in rows})
    n = np.array([sum(x == k for _, x, _ in rows) for k in xs], float)
    x, y = calibration.pava(np.array(xs), np.array([sum(y for _, x, y in rows if x == k) for k in xs]) / n, n)
    assert len(got) == len(x) and np.allclose(np.array(got), np.stack([x, y], axis=1), rtol=0, atol=1e-12)


@pytest.mark.parametrize("per", [3, 10**6])
def test_calibration_by_order_is_that_by_broadcast(spark, monkeypatch, per):
    monkeypatch.setattr(order, "PER", per)
    draw = random.Random(per)
    fits = {h: sorted({draw.random() for _ in range(12)}) for h in "ab"} | {"one": [0.5]}
    points = spark.createDataFrame([(h, x, k / 12) for h, xs in fits.items() for k, x in enumerate(xs)], "head string, x double, y double")
    scores = [(draw.choice(["a", "b", "one", "none"]), draw.choice([None, draw.random() * 1.4 - 0.2, *fits["a"]]), k) for k in range(80)]
    rows = spark.createDataFrame(scores, "head string, score double, pos int")
    want = sorted(map(str, calibration.apply(rows, points).collect()))
    monkeypatch.setattr(calibration, "MOST", 0)
    assert sorted(map(str, calibration.apply(rows, points).collect())) == want


@pytest.mark.parametrize("per", [4, 10**6])
def test_places_in_one_order(spark, monkeypatch, per):
    monkeypatch.setattr(order, "PER", per)
    frame = spark.range(50).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(9)))
    got = [(r["x"], r["id"], r["at"]) for r in order.numbered(frame, "at", F.desc("x"), F.col("id")).orderBy("at").collect()]
    assert got == [(x, i, k) for k, (x, i) in enumerate(sorted(((x, i) for x, i, _ in got), key=lambda p: (-p[0], p[1])))] and len(got) == 50
    shards = frame.select(F.col("id").alias("shard"))
    whole = {r["shard"]: r["turn"] for r in sampling.epoch_shards(shards, 5, 2).collect()}
    assert sorted(whole.values()) == list(range(50))
    assert {r["shard"]: r["turn"] for r in sampling.epoch_shards(shards, 5, 2, 7).collect()} == {s: t for s, t in whole.items() if t < 7}


def test_locate_beside_a_long_shard(spark):
    sizes = [(0, 1), (1, 400), (2, 0), *((k, 1) for k in range(3, 40))]
    found = sampling.locate(spark.range(-2, 450).withColumnRenamed("id", "i"), sampling.offsets(spark.createDataFrame(sizes, "shard int, n long")))
    want = [(s, r) for s, n in sizes for r in range(n)]
    assert sorted((r["i"], r["shard"], r["row"]) for r in found.collect()) == [(i, *x) for i, x in enumerate(want)]


def test_network(spark):
    weights = scoring.random_weights(1)
    x = np.random.default_rng(0).random((2, 22, 6), np.float32)
    one, w = np.zeros((1, 1, 4), np.float32), np.array([[[1, 2, 3]]], np.float32)
    one[0, 0] = [1, 0, 2, 0]
    assert scoring.conv1d(one, w)[0, 0].tolist() == [2.0, 7.0, 4.0, 2.0]
    for padding in (1, 2):  # plain convolution, one output at a time
        v, k = np.random.default_rng(5).random((2, 3, 9), np.float32), np.random.default_rng(6).random((4, 3, 2 * padding + 1), np.float32)
        edge = np.pad(v, ((0, 0), (0, 0), (padding, padding)))
        want = [[[float((edge[b, :, t : t + 2 * padding + 1] * k[o]).sum()) for t in range(9)] for o in range(4)] for b in range(2)]
        assert np.allclose(scoring.conv1d(v, k), want, rtol=1e-5)
    # rows of one batch, the shorter one padded
    rows = spark.createDataFrame([("a", 1, x[0].T.tolist()), ("b", 2, x[1].T[:3].tolist()), ("c", 3, [])], "id string, taxon long, bins array<array<float>>").coalesce(1)
    for weights, network in ((weights, scoring.forward), (residual.random_weights(1), residual.forward)):
        for name in [n for n in weights if n.endswith((".shift", ".bias"))]:
            weights[name] = np.random.default_rng(len(name)).standard_normal(weights[name].shape).astype(np.float32)
        got = {r["id"]: r for r in scoring.score(rows, weights, network=network).collect()}
        alone = {r["id"]: r for r in scoring.score(rows.where("id = 'b'"), weights, network=network).collect()}
        assert set(got) == {"a", "b"} and all(0 <= got["a"][f"prob_{r}"] <= 1 for r in RANKS)
        assert all(math.isclose(got["b"][f"prob_{r}"], alone["b"][f"prob_{r}"], abs_tol=1e-6) for r in RANKS)


def test_network_by_loops():
    """The whole forward pass of one row, written as sums."""
    w = scoring.random_weights(3)
    draw = np.random.default_rng(0)
    for k in w:
        if k.endswith(("scale", "shift")):
            w[k] = draw.random(w[k].shape, np.float32) + 0.1
    x = draw.random((22, 4)).astype(np.float64)

    def conv(x, weight, name):
        weight = weight[:, :, None] if weight.ndim == 2 else weight
        edge, t = weight.shape[2] // 2, x.shape[1]
        out = np.zeros((len(weight), t))
        for o in range(len(weight)):
            for at in range(t):
                for j in range(weight.shape[2]):
                    if 0 <= at + j - edge < t:
                        out[o, at] += weight[o, :, j] @ x[:, at + j - edge]
                out[o, at] = max(0.0, out[o, at] * w[f"{name}.scale"][o] + w[f"{name}.shift"][o])
        return out

    h = x
    for k in range(5):
        if f"block{k}.reduce" in w:
            h = conv(h, w[f"block{k}.reduce"], f"block{k}.reduce")
        h = conv(h, w[f"block{k}.conv"], f"block{k}")
    v = np.append(h.mean(axis=1), np.log1p(4))
    for k in range(3):
        v = w[f"head{k}.weight"] @ v + w[f"head{k}.bias"]
        v = np.maximum(v, 0) if k < 2 else v
    got = scoring.forward(x[None].astype(np.float32), np.ones((1, 1, 4), np.float32), np.log1p([4.0]).astype(np.float32), w)
    assert np.allclose(got[0], v, rtol=1e-3)


def test_padding_to_the_shard(spark):
    draw = np.random.default_rng(1)
    w = scoring.random_weights(2)
    bins = {name: (draw.integers(0, 64, (n, 22)) / 64).tolist() for name, n in (("a", 2), ("b", 5), ("c", 3))}
    frame = lambda shard: spark.createDataFrame([(i, 1, b, shard[i]) for i, b in bins.items()], "id string, taxon long, bins array<array<float>>, shard string")

    def want(i, width):
        x = np.zeros((1, 22, width), np.float32)
        x[0, :, : len(bins[i])] = np.array(bins[i]).T
        return 1 / (1 + np.exp(-scoring.forward(x, np.ones((1, 1, width), np.float32), np.log1p([width]).astype(np.float32), w)[0]))

    for shard, widths in (({"a": "x", "b": "x", "c": "y"}, {"a": 5, "b": 5, "c": 3}), ({"a": "x", "b": "y", "c": "x"}, {"a": 3, "b": 5, "c": 3})):
        got = {r["id"]: [r[f"prob_{x}"] for x in RANKS] for r in scoring.score(frame(shard), w, pad="shard").collect()}
        assert all(np.allclose(got[i], want(i, n), atol=1e-6) for i, n in widths.items())
    own = {r["id"]: [r[f"prob_{x}"] for x in RANKS] for r in scoring.score(frame(shard), w).collect()}
    assert all(np.allclose(own[i], want(i, len(b)), atol=1e-6) for i, b in bins.items()) and not np.allclose(own["a"], got["a"], atol=1e-6)
    with pytest.raises(ValueError):
        scoring.score(frame(shard), w, pad="batch")


def test_residual_network():
    """Against plain loops over channels and places."""
    w = residual.random_weights(3)
    x, extra = np.random.default_rng(2).standard_normal((1, 22, 9)), np.log1p(np.array([9.0]))
    gelu = np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))

    def conv(v, name, dilation=1, stride=1):
        k = w[name].shape[2]
        out = np.zeros((len(w[name]), -(-v.shape[1] // stride)))
        for o, t, j in itertools.product(range(out.shape[0]), range(out.shape[1]), range(k)):
            at = t * stride + (j - k // 2) * dilation
            if 0 <= at < v.shape[1]:
                out[o, t] += w[name][o, :, j] @ v[:, at]
        return out

    h = gelu(conv(x[0], "stem"))
    for k, (dilation, stride) in enumerate([(1, 1), (2, 1), (1, 2), (2, 1), (1, 2), (2, 1)]):
        skip = conv(h, f"block{k}.skip", stride=stride) if stride == 2 else h
        h = gelu(conv(h, f"block{k}.reduce", stride=stride))
        h = gelu(conv(gelu(conv(h, f"block{k}.conv", dilation)), f"block{k}.expand") + skip)
    v = gelu(w["head0.weight"] @ np.append(h.mean(axis=1), extra) + w["head0.bias"])
    assert h.shape == (256, 3) and np.allclose(residual.forward(x, np.ones((1, 1, 9)), extra, w)[0], w["head1.weight"] @ v + w["head1.bias"], atol=1e-5)


def test_rounding_to_short_types_alone_stays_finite(spark):
    rows = spark.createDataFrame([(73920.0,), (-70001.0,), (1.0001,), (0.0,)], "v double")
    got = rows.select(tensors.rounded(F.col("v"), "float16").alias("r"), tensors.to_dtype(F.col("v"), "fp16").alias("h")).collect()
    assert [r["r"] for r in got] == [73920.0, -70016.0, 1.0, 0.0]
    assert [r["h"] for r in got] == [float("inf"), float("-inf"), 1.0, 0.0]


def test_lineage_focal_has_no_function_of_array_elements(spark):
    rows = spark.createDataFrame([([0.5] * 7, [1] * 7)], "x array<double>, y array<int>")
    plan = rows.agg(metrics.lineage_focal(F.col("x"), F.col("y")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan

"""Fill-in-middle, spelling variants and nearest neighbours, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxaloom.llm import infill, neighbours, spelling


def _cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("long", "chunk"), [(65_536, 16_384), (60, 64), (20, 7)])
def test_infill_is_the_plain_cut(spark, docs, rows, long, chunk):
    more = [(k, x * 9, *rows[0][2:]) for k, x in enumerate(["ab<P", ">a<P> c", "é<<M>z1", "<S <P a>", "\U0001f642a\n\r"], 100)] * 2
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = infill.infill(table, long=long, chunk=chunk).withColumn("text", infill.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(str, (r[:6] for r in got))) == sorted(str(_cut(*r[:2])) for r in rows + more)
    assert Counter(r[6] for r in got) == Counter(r[1] or "" for r in rows + more)


def test_infill_of_nothing(empty):
    assert infill.digests(empty).count() == 0


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(st.text("ab<>PSM é1", max_size=300), min_size=1, max_size=5), st.integers(0, 400))
def test_scan_composes(texts, wanted):
    scan = infill.Scan(texts)
    units = [[m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t, re.S)] for t in texts]
    for k, t in enumerate(texts):
        after, n = scan.function(k)
        assert n[0] == len(units[k]) and (after[0] >= 4) == bool(re.search("<[PSM]>", t))
        assert n[1] == len(units[k]) - (t[:1].isascii() and t[:1].isalpha())  # entered within a run
    got = scan.select(np.arange(len(texts)), np.zeros(len(texts), np.int64), np.full(len(texts), wanted))
    assert got.tolist() == [u[wanted] if wanted < len(u) else len(t) for u, t in zip(units, texts, strict=True)]


def _variants(rows, least, often, times):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("shard", "most", "small"), [(4096, 4096, 100_000), (20, 3, 0)])
def test_variants_are_all_near_words(spark, monkeypatch, shard, most, small):
    for name, value in (("SHARD", shard), ("MOST", most), ("SMALL", small)):
        monkeypatch.setattr(spelling, name, value)
    draw = random.Random(4)
    pool = ["".join(draw.choice("abÀé") for _ in range(draw.randint(5, 9))) for _ in range(60)]
    pool += ["abcdef", "abcdefg", "xabcdef", "abcxdef", "abcdeX", "ABCdef", "prefixx", "prefixy", "prefixz", "prefix", "aprefix"] * 3
    made = [(None if k % 50 == 0 else k, " ".join(draw.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=40)) + "-x1") for k in range(120)] + [(1, None), (2, ""), (3, "12 !"), (3, "12 !")]
    made += [(900, "chainnn " * 50 + "chainnm " * 10 + "chainmm " * 4)] * 2
    table = spark.createDataFrame([(i, t, "clash", 0) for i, t in made], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.variants(table, least=5, often=2, times=2).collect()]
    want = _variants(made, 5, 2, 2)
    assert sorted(map(str, got)) == want
    assert any(r[1] != r[2] and r[1] for r in got)  # a chain of forms


def test_variants_of_nothing(empty, docs):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(docs.where("text is null")).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_shards_report_each_pair_once(monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW", few)
    draw = random.Random(few)
    every = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(2, 7))) for _ in range(150)})
    shard = spelling.Shard([(left, w, 1) for w in every for left in (True, False)])
    for w in every:
        assert sorted(e[1] for e in shard.near(w)) == [v for v in every if spelling.one_edit(w, v)]
    assert not spelling.one_edit("ab", "ab") and not spelling.one_edit("ab", "ba") and spelling.one_edit("", "a")


def _nearest(rows, k, every):
    own = [(i, np.array([float(x) for x in v])) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for j, (i, q) in enumerate(own):
        if i % every == 0:
            near = sorted((neighbours.distances(q[None], x)[0], o) for m, (o, x) in enumerate(own) if m != j and len(x) == len(q))[:k]
            out += [(i, r, o, float(d)) for r, (d, o) in enumerate(near, 1)]
    return sorted(out)


def _vectors(seed, n, dim, copies):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    x = centres[draw.integers(0, 12, n)] + 0.05 * draw.standard_normal((n, dim))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(n + k, rows[5][1]) for k in range(copies)]


ODD = [(1000, None), (1100, []), (1200, [0.0] * 4), (1300, [1.0, None, 2.0, 3.0]), (1400, [1.0, float("nan"), 2.0, 3.0]), (1500, [float("inf")] * 4), (None, [1.0] * 4), (1600, [1.0, 2.0]), (1700, [1.0, 2.5]), (1800, [1.0]), (1900, [1e200, -1e200, 0.0, 1.0]), (20, [-0.0, 1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0])]


@pytest.mark.parametrize(("size", "small"), [(4 << 20, 100_000), (2000, 100_000), (500, 0)])
def test_nearest_is_exact_at_factor_one(spark, monkeypatch, size, small):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "SMALL", small)
    rows = _vectors(3, 400, 4, 150) + ODD + [(30, [0.0, 1.0, 0.0, 0.0])] * 2
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, key string, id int").repartition(3)
    got = sorted(tuple(r) for r in neighbours.nearest(table, k=10, every=10, shard_bytes=size).collect())
    assert got == _nearest(rows, 10, 10)


def test_nearest_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (200, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in neighbours.nearest(table).collect()) == [(0, 1, 100, 1.0), (0, 2, 200, 1.0), (100, 1, 200, 0.0), (100, 2, 0, 1.0), (200, 1, 100, 0.0), (200, 2, 0, 1.0)]
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0")).count() == 0


def test_relaxed_pruning_visits_less_and_keeps_most():
    x = np.array([v for _, v in _vectors(5, 4000, 8, 0)])
    seen = Counter()

    class Counted(neighbours.Tree):
        def search(self, *a):
            whole = neighbours.distances
            try:
                neighbours.distances = lambda a, b: seen.update({"pairs": len(a)}) or whole(a, b)
                return super().search(*a)
            finally:
                neighbours.distances = whole

    tree, recall, pairs = Counted(x, [np.array([k]) for k in range(len(x))]), [], []
    want = np.argsort(((x[::100, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :10]
    for factor in (1.0, 1.5, 3.0):
        seen.clear()
        _, place = tree.search(x[::100], np.full(40, np.inf), 10, factor)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(place.tolist(), want.tolist(), strict=True)]))
        pairs.append(seen["pairs"])
    assert recall[0] == 1 and recall[1] >= 0.9 and pairs[0] > pairs[1] > pairs[2]
    assert pairs[0] < 40 * 4000 / 2  # pruning works on what is clustered

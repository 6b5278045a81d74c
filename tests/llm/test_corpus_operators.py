"""Dedup, near dedup, decontamination, repeats, sharding and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
import public_tokenizers
from taxaloom import session
from taxaloom.llm import bpe, components, decontaminate, exact_dedup, golomb, langid, repeats, runindex, sharding, simhash

from .conftest import SCHEMA, words


@settings(max_examples=100, deadline=None, database=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=60), st.integers(0, 47))
def test_golomb_round_trip(values, width):
    own = np.array(sorted(values), np.uint64)
    width = max(width, golomb.rice_bits(2**48, max(1, len(own))) - 6)
    assert golomb.decode(golomb.encode(own, width), len(own), width).tolist() == own.tolist()


def test_exact_dedup(docs, empty, rows):
    got = exact_dedup.groups(docs).collect()
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    size = Counter(squeezed(t) for _, t, *_ in rows)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(size)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, n in size.items():
        own = by[hashlib.sha256(text.encode()).hexdigest()]
        assert len(own) == n and {r["group_size"] for r in own} == {n} and sum(r["kept"] for r in own) == 1
        best = min((-len(t or ""), i is None, i or 0) for i, t, *_ in rows if squeezed(t) == text)
        assert {r["keep_id"] for r in own} == {None if best[1] else best[2]}
    assert exact_dedup.groups(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)


def plain_fingerprint(text, n):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not parts:
        return 0
    grams = [b" ".join(parts[k : k + n]) for k in range(max(1, len(parts) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_rows(docs, empty, rows):
    got = simhash.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{plain_fingerprint(t, 3):016x}") for i, t, *_ in rows)
    assert simhash.near_groups(empty).count() == 0
    least = defaultdict(list)
    for r in got:
        least[r["fingerprint"]].append(r)
    assert all(len({r["component_id"] for r in own}) == 1 for own in least.values())


@pytest.mark.parametrize(("long_", "small"), [(256, 100_000), (2, 100_000), (2, 0)])
def test_links_are_whole(spark, monkeypatch, long_, small):
    monkeypatch.setattr(simhash, "LONG", long_)
    monkeypatch.setattr(simhash, "SMALL", small)
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(30)]
    fps = {b for b in base} | {b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(6)}
    fps |= {base[0] ^ (k << 8) for k in range(300)}  # one list with many
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bits in (0, 1, 2):
        got = components.components(simhash.links(frame, bits)).collect()
        pairs = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
        want = union(pairs, signed)
        have = {x: x for x in signed} | {r["node"]: r["root"] for r in got}
        assert have == want
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_components_of_documents_are_brute_force(spark):
    draw = random.Random(29)
    texts = [None, "", " ", "a", "A", "a b", "a b c", "a b c d"]
    for seed in range(30):
        base = words(6000 + seed, draw.choice([3, 5, 30, 200, 400])).split()
        for _ in range(7):
            own = [*base]
            for _ in range(draw.choice([0, 1, 1, 2])):
                own[draw.randrange(len(own))] = draw.choice(["zz", "yy"])
            texts.append(draw.choice([" ", "\n", "\x0b "]).join(own))
    draw.shuffle(texts)
    ids = [*range(len(texts) - 2), 0, None]
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    fps = [plain_fingerprint(t, 3) for t in texts]
    near = [(a, b) for a, x in enumerate(fps) for b, y in enumerate(fps[:a]) if (x ^ y).bit_count() <= 2]
    assert sum(fps[a] != fps[b] for a, b in near) > 20
    root = union(near, range(len(texts)))
    low = {k: min((ids[j] for j in root if root[j] == k and ids[j] is not None), default=None) for k in set(root.values())}
    got = simhash.near_groups(table).collect()
    want = sorted((str(ids[k]), f"{fps[k]:016x}", str(low[root[k]])) for k in range(len(texts)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_near_copies_go(spark, docs, empty, rows):
    text = words(50, 400).split()
    near = [*text]
    near[200] = "changed"
    table = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, words(51, 400)), (4, " ".join(text))], "doc_id long, text string")
    kept = simhash.drop_similar(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    some = simhash.drop_similar(docs)
    assert some.columns == docs.columns and {1, 4, 10, 13} <= {r["doc_id"] for r in some.collect()}
    assert sum(r["doc_id"] == 12 for r in some.collect()) == 1
    assert simhash.drop_similar(empty).count() == 0


def changed(text, places, mark):
    return [f"{mark}{k}" if k in places else w for k, w in enumerate(text)]


def plain_shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def test_near_keeps_texts_below_the_limit(spark):
    texts = []
    for seed in range(40):  # Jaccard 0.60, 0.71 and 0.75, which fingerprints often take for 0.8
        short, mid, long_ = (words(900 + seed, n).split() for n in (8, 10, 90))
        texts += [short, [*short[:-1], "last"], mid, [*mid[:-1], "last"], long_, changed(long_, {20, 60, 85}, "c")]
    texts = [" ".join(t) for t in texts]
    assert all(0.5 < jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.drop_similar(table).count() == len(texts)


@pytest.mark.parametrize(("many", "sample", "often"), [(256, 8, 6), (1, 1, 10**9), (256, 1, 2)])
def test_near_finds_all_texts_above_the_limit(spark, monkeypatch, many, sample, often):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "COMMON", often)
    texts = []
    for seed in range(60):  # Jaccard 0.81 and 0.8
        long_, short = words(2000 + seed, 100).split(), words(3000 + seed, 13).split()
        texts += [long_, changed(long_, {20, 60}, "c"), short, [*short[:-1], "last"]]
    texts = [" ".join(t) for t in texts]
    assert all(0.8 <= jaccard(a, b) < 0.82 for a, b in zip(texts[::2], texts[1::2], strict=True))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_similar(table).collect()) == [*range(0, len(texts), 2)]


@pytest.mark.parametrize(("block", "many"), [(256, 256), (3, 2)])
def test_near_is_brute_force(spark, monkeypatch, block, many):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "MANY", many)
    draw = random.Random(11)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b  c d e", "a b c d e f"]
    line = words(4000, 30).split()
    for seed in range(24):
        base = words(4100 + seed, draw.choice([6, 8, 10, 13, 14, 25, 60, 100, 200])).split()
        base = base if seed % 3 else [*line, *base]  # many share a line
        for _ in range(6):
            gone = set(draw.sample(range(len(base)), min(len(base), draw.randint(0, 1 + len(base) // 40))))
            own = [f"x{draw.randint(0, 3)}" if k in gone else w for k, w in enumerate(base)]
            texts.append(" ".join([*own, *words(draw.randint(0, 999), draw.choice([0, 0, 1, 2])).split()]))
    draw.shuffle(texts)
    sets = [plain_shingles(t or "") for t in texts]
    near, just = [], [0, 0]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            share = len(x & y) / len(x | y) if x | y else 1.0
            just[0] += 0.7 <= share < 0.8
            just[1] += 0.8 <= share < 0.9
            if share >= 0.8:
                near.append((a, b))
    assert min(just) > 20
    root = union(near, range(len(texts)))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(table).collect()) == sorted(set(root.values()))


def test_a_form_makes_no_group(spark, monkeypatch):
    """Texts on one form of 0.84 of their shingles, in twos that share the rest: no text is a candidate for all others."""
    draw = random.Random(12)
    form = [f"form{k}" for k in range(172)]
    texts = []
    for k in range(1200):
        own = [f"own{k // 2}x{j}" for j in range(31)]
        own[draw.randrange(31)] += "ab"[k % 2]
        texts.append(" ".join(form + own))
    written, store = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: (written.__setitem__(name, out := store(df, name)), out)[1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(table).collect()) == list(range(0, 1200, 2))
    assert written["near-candidates"].count() < 3000  # 719,400 pairs in all


def test_equal_hashes_of_shingles_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 10, 7), (4, 11, 5), (5, 10, 9)], "id long, node long, check long")
    got = {r["id"]: r["node"] for r in simhash._told_apart(rows).collect()}
    assert got[1] == got[2] == 10 and got[4] == 11 and len({got[1], got[3], got[4], got[5]}) == 4


ITEM = "zero one two three four five six seven eight nine ten eleven"


def plain_contamination(docs, items, width, slack=2):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[k : k + width])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, met, near, exact = cut(text), set(), set(), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    met |= wins[tuple(w[k : k + n])]
                    exact.add(tuple(w[k : k + n]))
        for x in wins:
            for k in range(len(w)):
                if all(x[j] in w[max(0, k + j - slack) : max(0, k + j + slack + 1)] for j in range(len(x))):
                    near.add(x)
        out.append((str(i), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit), len(near - exact)))
    return sorted(out)


@pytest.mark.parametrize("small", [100_000, 0])
def test_contamination(spark, docs, empty, rows, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    items = [(1, ITEM), (2, "Zero one, two"), (10, ITEM), (3, None), (4, "..."), (None, "short item"), (5, "the the the the the the the the the the the")]
    own = [(20, f"x {ITEM.upper()} y"), (21, ITEM.replace("five", "5")), (22, "zero one two zero one two"), (23, "short item"), (24, "the " * 14), *((i, t) for i, t, *_ in rows)]
    full = spark.createDataFrame([(*r, None, None, 0, 0, "", "", "", "", "") for r in own], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(full, bench).collect()
    assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == plain_contamination(own, items, 10)
    kept = decontaminate.drop_contaminated(full, bench)
    clean = sorted(x[0] for x in plain_contamination(own, items, 10) if not x[5])
    assert kept.columns == full.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == clean and "20" not in clean
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(full, bench.limit(0)).collect())


def test_words_of_a_document_move_once(spark, monkeypatch):
    """Beyond a broadcast only places and terms are dealt by term; a text of 20,000 words isn't sent with each of them."""
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    written, store = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: (written.setdefault(name, df), store(df, name))[1])
    base = words(77, 20_000, "abcdefgh").split()
    items = [(k, " ".join(base[900 * k : 900 * k + 12])) for k in range(20)]
    own = [(1, " ".join(base)), (2, " ".join(base[5000:5100])), (None, items[3][1]), (3, None), (1, " ".join(base))]
    table = spark.createDataFrame(own, "doc_id long, text string")
    got = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"), 10, 2).collect()
    assert sorted((str(r["doc_id"]), *r[1:6]) for r in got) == [x[:6] for x in plain_contamination(own, items, 10, 0)]
    plan = written["bench-places"]._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(term" in x]
    assert dealt and not any(re.search(r"\bw#", plan.splitlines()[k + 1]) for k, x in enumerate(plan.splitlines()) if x in dealt)


@pytest.mark.parametrize(("small", "slack"), [(100_000, 2), (100_000, 0), (100_000, 1), (0, 2)])
def test_contamination_by_proximity(spark, monkeypatch, small, slack):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    draw = random.Random(23)
    base = [words(5000 + k, draw.choice([3, 9, 10, 11, 18, 25]), "abcd").split() for k in range(14)]
    items = [(k, " ".join(b)) for k, b in enumerate(base)] + [(50, " ".join(base[3])), (51, "one"), (52, "one one two")]
    own = []
    for k in range(160):
        part = [*draw.choice(base)]
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):  # words put in, left out, changed or moved
            at = draw.randrange(len(part))
            part[at : at + draw.choice([0, 1, 1])] = draw.choice([[], ["zz"], ["zz", "yy"], [draw.choice(part)]])
            if not part:
                part = ["one"]
        if draw.random() < 0.3:
            part[0], part[-1] = part[-1], part[0]
        front, back = words(k, draw.choice([0, 1, 3, 20]), "abcd"), words(k + 999, draw.choice([0, 2, 20]), "abcd")
        own.append((k, f"{front} {' '.join(part)} {back} {' '.join(part)}"))
    table = spark.createDataFrame(own, "doc_id long, text string")
    got = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"), 10, slack).collect()
    want = plain_contamination(own, items, 10, slack)
    assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == want
    assert sum(x[5] for x in want) > 20 and (not slack or sum(x[6] > 0 for x in want) > 20)


@settings(max_examples=150, deadline=None, database=None)
@given(st.lists(st.binary(max_size=30) | st.text("ab", max_size=30).map(str.encode), max_size=6), st.integers(1, 6))
def test_run_index(strings, width):
    count = Counter(s[k : k + width] for s in strings for k in range(len(s) - width + 1))
    assert [x.tolist() for x in runindex.repeated_starts(strings, width)] == [[k for k in range(len(s) - width + 1) if count[s[k : k + width]] > 1] for s in strings]


@settings(max_examples=150, deadline=None, database=None)
@given(st.lists(st.text("01", max_size=70).map(str.encode) | st.integers(0, 70).map(lambda n: b"0" * n), max_size=5), st.integers(8, 24))
def test_run_index_of_wide_windows(strings, width):
    count = Counter(s[k : k + width] for s in strings for k in range(len(s) - width + 1))
    assert [x.tolist() for x in runindex.repeated_starts(strings, width)] == [[k for k in range(len(s) - width + 1) if count[s[k : k + width]] > 1] for s in strings]


@pytest.mark.parametrize("tail", [b"", b"same after it, and more of it than a word of the machine holds"])
def test_run_index_where_one_bit_differs(tail):
    for run in range(8, 90):
        common = bytes(random.Random(run).choices(b"abcdefgh", k=run))
        for a, b in (b"01", b"bc", b"\x00\x80"):
            strings = [common + bytes([a]) + tail, common + bytes([b]) + tail]
            for width in (run - 1, run, run + 1):
                count = Counter(s[k : k + width] for s in strings for k in range(len(s) - width + 1))
                assert [x.tolist() for x in runindex.repeated_starts(strings, width)] == [[k for k in range(len(s) - width + 1) if count[s[k : k + width]] > 1] for s in strings]


def plain_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - width + 1):
            if count[d[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [1 << 19, 1])
def test_repeats(spark, docs, empty, rows, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    own = [t for i, t, *_ in rows if i != 13]
    got = repeats.remove_repeats(docs.where("doc_id is null or doc_id <> 13"), 100).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_repeats(own, 100)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(empty).count() == 0


def near_copies():
    """Shared headers with other ends, copies that differ in one bit, periodic texts of many periods, parts of one another."""
    draw = random.Random(17)
    head, own = words(70, 60), words(71, 200)
    texts = [head + " " + words(72 + k, 40) for k in range(12)] + [words(90 + k, 8) + head for k in range(5)]
    texts += [own[:300] + x + own[300:900] for x in ("0", "1", "b", "c")] + [own[100:600], own[250:420]]
    texts += ["a" * 3000, "a" * 250, "b" + "a" * 180, *(words(200 + p, 60).replace(" ", "")[:p] * (1500 // p) for p in (2, 3, 7, 10, 40, 64, 99, 150)), ("ab" * 700)[1:], "é" * 400]
    texts += [" ".join(draw.choice(["lorem ipsum", "dolor sit", head[:90]]) for _ in range(40)) for _ in range(4)]
    return texts


@pytest.mark.parametrize(("crowd", "stretch", "piece"), [(1 << 19, 1 << 20, 8192), (1, 333, 50), (2000, 1 << 20, 300)])
def test_repeats_of_near_copies_and_periods(spark, monkeypatch, crowd, stretch, piece):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = near_copies()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove_repeats(table, 120).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_repeats(texts, 120)


def test_periodic_text_is_extracted_about_once():
    for unit in (b"a", b"ab", b"0123456789", bytes(range(97, 122)) * 2):
        text = np.frombuffer((unit * 100_000)[:100_000], np.uint8)
        a, b, _, times = repeats.segments(text, 400)
        assert a[0] == 0 and b[-1] == len(text) - 400 and (a[1:] == b[:-1] + 1).all() and times.sum() >= len(a)
        assert sum(b - a + 400) < 2 * len(text)


def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, fill = 1, 0
        for s in sizes:
            if fill + s > mid:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_sharding(spark, docs, empty, rows):
    for shards in (1, 3, 24):
        got = sharding.shard(docs, shards).collect()
        assert len(got) == len(rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sharding.shard(empty).count() == 0
    draw = random.Random(9)
    made = spark.createDataFrame([(k, "x" * draw.randint(1, 300) + str(draw.randint(0, 400))) for k in range(900)], "doc_id long, text string")
    groups = sharding.sized(made).groupBy("_digest").agg({"size": "sum", "*": "count"}).toDF("_digest", "_bytes", "_rows")
    sizes = [r["_bytes"] for r in groups.orderBy("_digest").collect()]
    assert sharding.plan_cuts(groups, 24)[0] == plain_capacity(sizes, 24)
    placed = sharding.shard(made).groupBy("text_crc32").agg({"shard": "min"}).count()
    assert placed == len(sizes)


@pytest.mark.parametrize("heavy", [[], [40_000], [30_000, 29_000, 9_000], [9_000] * 8])
def test_sharding_is_contiguous_minimal_and_even(spark, heavy):
    draw = random.Random(19)
    sizes = {f"{draw.getrandbits(256):064x}": draw.randint(8, 300) for _ in range(700)}
    sizes |= {f"{draw.getrandbits(256):064x}": n for n in heavy}
    own = sorted(sizes.items())
    groups = spark.createDataFrame([(d, n, 1) for d, n in own], "_digest string, _bytes long, _rows long")
    capacity, starts = sharding.plan_cuts(groups, 24)
    assert capacity == plain_capacity([n for _, n in own], 24)
    filled, large = Counter(), Counter()
    for d, n in own:
        k = sum(d >= s for s in starts)
        filled[k] += n
        large[k] = max(large[k], n)
    assert len(filled) == 24 and max(filled.values()) <= capacity
    # heavy groups have a shard each; the others are even up to a group at either end
    light = [n for k, n in filled.items() if large[k] <= 300]
    assert len(light) == 24 - len(heavy) and all(filled[k] == n for k, n in large.items() if n > 300)
    assert max(light) <= sharding_capacity_between(own, 24)
    if len(heavy) < 4:
        assert max(light) - min(light) <= 0.25 * max(light) + 600


def sharding_capacity_between(own, shards):
    """Smallest capacity of the shards between groups above 300."""
    runs, run = [], []
    for _, n in own:
        if n > 300:
            runs.append(run)
            run = []
        else:
            run.append(n)
    runs = [r for r in [*runs, run] if r]
    left = shards - sum(n > 300 for _, n in own)
    for capacity in range(max(map(max, runs)), sum(map(sum, runs)) + 1):
        used = 0
        for r in runs:
            fill, used = 0, used + 1
            for n in r:
                if fill + n > capacity:
                    fill, used = 0, used + 1
                fill += n
        if used <= left:
            return capacity
    return None


def test_sharding_numbers_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 2)
    made = spark.createDataFrame([(None if k % 2 else 7, "same" if k % 3 else f"t{k}") for k in range(400)], "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in sharding.shard(made, 5).collect():
        got[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in got.values()) and sum(map(len, got.values())) == 400


def test_one_of_each_group_of_copies_stays(spark, docs, rows):
    """By brute force, with copies that differ in white space and rows that are equal throughout."""
    draw = random.Random(6)
    pool = [words(k, 4) for k in range(9)]
    more = [(draw.choice([None, 1, 2, 3, 40]), draw.choice(["", " "]) + draw.choice(pool).replace(" ", draw.choice([" ", "  ", "\n"]))) for _ in range(90)]
    table = docs.unionByName(spark.createDataFrame([(*r, None, None, 0, 0, "", "", "", "", "") for r in more], SCHEMA))
    best = {}
    for i, t in [r[:2] for r in rows] + more:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, False, 0, None)), (-len(t or ""), i is None, i or 0, t or ""))
    kept = exact_dedup.drop_copies(table)
    assert Counter((str(r["doc_id"]), r["text"] or "") for r in kept.collect() if (r["text"] or "").strip()) == Counter((str(None if n else i), t) for k, (_, n, i, t) in best.items() if k)
    assert kept.count() == len(best)


def test_stages_on_nothing(spark, empty):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (exact_dedup.drop_copies(empty), langid.keep_identified(empty), simhash.drop_similar(empty), decontaminate.drop_contaminated(empty, bench), bpe.encode_decode(empty, path)):
        assert out.count() == 0


def test_the_pipeline_leaves_its_result_alone(spark, docs, tmp_path, monkeypatch):
    (tmp_path / "sf").mkdir()
    (tmp_path / "scratch").mkdir()
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/scratch")
    got = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert {1, 4, 10, 13} & {r["doc_id"] for r in got.collect()}
    assert [p.name[:15] for p in (tmp_path / "scratch").iterdir()] == ["pipeline-tokens"]


def test_pipeline_stages(spark, docs, tmp_path):
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    now = docs.unionByName(spark.createDataFrame([(30, ITEM + " " + words(60, 40), "en", None, 1, 0, "", "", "", "", "")], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path / "t"))
        if name != "tokens":
            assert now.columns == before.columns
    left = {r["doc_id"] for r in now.collect()}
    assert {1, 4, 10, 13} & left and {6, 7, 8, 9, 30}.isdisjoint(left) and not {2, 5} & left


def test_the_near_stage_drops_what_fingerprints_link(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(30)]
    rows = []
    for k, t in enumerate(texts):
        own = t.split()
        rows += [(10 * k, t), (10 * k + 1, " ".join([*own[:200], "other", *own[201:]])), (10 * k + 2, " ".join(own[: -(k % 7 + 1)]))]
    rows += [(None, texts[0]), (None, "nothing like it"), (0, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.fingerprint(t)[0] for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            root[i] = min(root[j] for j, y in enumerate(prints) if (x ^ y).bit_count() <= 2)
    want = {min(((rows[i][0] is None, rows[i][0] or 0, rows[i][1]) for i in range(len(rows)) if root[i] == r)) for r in set(root)}
    kept = simhash.drop_near(table).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept) == sorted(want) and len(want) < len(rows)
    ids = {r["doc_id"] for r in corpus_pipeline.near(spark, table, "").collect()}
    assert ids <= {r["doc_id"] for r in kept}

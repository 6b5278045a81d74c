"""Language, BPE, counts, personal data and token files, against libraries and brute force."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taxaloom.llm import bpe, langid, mixcoder, pii, token_counts, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_is_the_librarys(path):
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(max_size=80) | st.text("aAbs'tlé \n\t　١½<|>endoftxΣς", max_size=60))
    def same(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)

    same()
    for text in ("<|endoftext|>a<|endoftext|>", "a" * 5000, "ab" * 3000, "don't  STOP"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(docs, empty, rows):
    library = Tokenizer.from_file(WORD)
    got = bpe.encode_decode(docs, WORD).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert bpe.digests(empty, WORD).count() == 0
    assert bpe.digests(docs, WORD).count() == len(rows)


def test_language_learns_and_backs_off(spark, docs, empty, rows):
    sets = {"en": "the and with that", "de": "der und mit das"}
    draw = random.Random(1)
    made = [(i, " ".join(draw.choice(sets[lang].split()) for _ in range(8)), lang) for i in range(400) for lang in [draw.choice(list(sets))]]
    made += [(1000, "thex andy wither", None), (1001, None, "en"), (1002, "12 !", "en"), (1003, "", None)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    truth = {i: lang for i, _, lang in made}
    assert all(got[i]["lang_pred"] == truth[i] for i in range(400) if got[i]["held_out"])
    assert got[1000]["lang_pred"] == "en"  # unseen words, by their n-grams
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert langid.identify(docs).count() == len(rows)
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(table)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert kept.columns == table.columns and {1001, 1002, 1003}.isdisjoint(r["doc_id"] for r in kept.collect())


def plain_model(rows):
    """Word-first backoff with dictionaries: (lang, text) rows -> a function of a text."""
    cut = lambda t: re.findall(r"\w+", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()))
    langs = sorted({lang for lang, t in rows if cut(t)})
    tables = {0: Counter((w, lang) for lang, t in rows for w in cut(t))}
    for n in (1, 2, 3, 4):
        tables[n] = Counter((p[k : k + n], lang) for w, lang in tables[0] for p in [f"<{w}>"] for k in range(len(p) - n + 1))
    known = {n: {x for x, _ in c} for n, c in tables.items()}
    total = {(n, lang): sum(v for (_, at), v in c.items() if at == lang) + 0.5 * len(known[n]) for n, c in tables.items() for lang in langs}
    score = lambda n, x, lang: math.log((tables[n][x, lang] + 0.5) / total[n, lang])

    def of(word, lang):
        if word in known[0]:
            return score(0, word, lang)
        p = f"<{word}>"
        for n in (4, 3, 2, 1):
            if grams := [p[k : k + n] for k in range(len(p) - n + 1) if p[k : k + n] in known[n]]:
                return sum(score(n, g, lang) for g in grams) / len(grams)
        return 0.0

    def predict(text):
        found = cut(text)
        if not found or not langs:
            return "und", 0.0
        sums = [sum(of(w, lang) for w in found) * min(1, 25 / len(found)) for lang in langs]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        return langs[best], 1 / sum(math.exp(x - sums[best]) for x in sums)

    return predict


def test_language_is_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 50)
    monkeypatch.setattr(langid, "REMEMBERED", 30)
    draw = random.Random(5)
    pools = {"en": "aeth nd", "de": "eurnsch", "el": "αβγδε", "xx": "zqj½²"}
    word = lambda pool: "".join(draw.choice(pool) for _ in range(draw.randint(1, 7)))
    made = [(k, " ".join(word(pools[lang]) for _ in range(draw.randint(0, 40))), lang) for k in range(150) for lang in [draw.choice(list(pools))]]
    made += [(1000, "½ ² ① Ⅷ", None), (1001, "x½y ²z qq①", "en"), (1002, "日本 語 ǅ ª", None), (1003, "e" * 300, None), (None, "the nd", "en"), (None, None, "de"), (1004, "aeth", None), (1004, "aeth", None)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    plain = plain_model([(lang, t) for i, t, lang in made if lang is not None and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 5])
    got = sorted(((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in langid.identify(table).collect()))
    assert got == sorted((str(i), plain(t)[0], round(plain(t)[1], 6)) for i, t, _ in made)
    assert next(x for x in got if x[0] == "1000")[1:] == ("und", 0)


def test_language_sample_is_bounded_and_even(spark):
    made = [(k, "a", "big") for k in range(3000)] + [(5000 + k, "b", "mid") for k in range(900)] + [(9000 + k, "c", "low") for k in range(40)]
    table = spark.createDataFrame([*made, (1, None, "big"), (2, "x", None)], "doc_id long, text string, lang string")
    got = Counter(r["lang"] for r in langid.sample(table, 600).collect())
    assert got["low"] == 40 and all(200 < got[x] < 360 for x in ("big", "mid"))
    assert langid.sample(table, 10**9).count() == len(made)


def test_language_accuracy_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).where("held_out and lang_pred <> 'und'").join(table.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in got.collect()]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)


def plain_spans(text):
    """The contract's patterns, applied as they stand."""

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()]
        d[-2::-2] = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
        return 16 <= len(d) <= 19 and sum(d) % 10 == 0

    found = lambda p: re.finditer(p, text or "")
    return {
        "email": [m.span() for m in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in found(r"[0-9]([\x20-]?[0-9])+") if luhn(m[0])],
        "phone": [m.span() for m in found(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= sum(c.isdigit() for c in m[0]) <= 15],
    }


@settings(max_examples=1500, deadline=None, database=None)
@given(st.text("aB12590.@+-_% ()é:/\n", max_size=60))
def test_personal_data_matches_the_patterns(text):
    spans = pii.find(text)
    assert {k: spans[k] for k in pii.BASE} == plain_spans(text)


def test_personal_data_rows(docs, empty, rows):
    got = pii.detect(docs).collect()
    assert len(got) == len(rows) and pii.detect(empty).count() == 0
    one = next(r for r in got if r["doc_id"] == 17)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    text = "mail http://me:pw@host.org/x, IBAN: DE89 3704 0044 0532 0130 00 and account number: 12345678."
    assert pii.redact(text, pii.find(text)) == "mail <url>, IBAN: <iban> and account number: <account>."
    assert pii.listed(pii.find("nothing 2020 here, account of it")) == ""


@settings(max_examples=300, deadline=None, database=None)
@given(st.text("ab 's1é\n.", max_size=40), st.lists(st.tuples(st.integers(0, 45), st.integers(0, 6), st.text("ab 's\n1", max_size=5)), max_size=4))
def test_counts_follow_edits(text, edits):
    own = token_counts.counter(BYTE)
    tree = token_counts.CountTree(text, own)
    for start, n, new in edits:
        tree.edit(start, start + n, new)
    fresh = token_counts.CountTree(tree.text, own)
    assert (tree.total, tree.starts, tree.nodes.tolist()) == (fresh.total, fresh.starts, fresh.nodes.tolist())
    assert tree.total == len(Tokenizer.from_file(BYTE).encode(tree.text, add_special_tokens=False).ids) or "<|" in tree.text
    assert tree.between(0, tree.n) == tree.total


SPECIAL = "<|endoftext|>"


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(st.sampled_from([SPECIAL, "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "a", " b", "'s", "12", "é"]), max_size=12).map("".join), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 14), st.sampled_from(["", SPECIAL, "<|endof", "text|>", " ", ">", "x"])), max_size=4))
def test_counts_of_added_tokens_are_the_librarys(text, edits):
    own, library = token_counts.counter(BYTE), Tokenizer.from_file(BYTE)
    tree = token_counts.CountTree(text, own)
    assert tree.total == len(library.encode(text, add_special_tokens=False).ids)
    for start, n, new in edits:
        tree.edit(start, start + n, new)
        fresh = token_counts.CountTree(tree.text, own)
        assert (tree.total, tree.starts, tree.nodes.tolist()) == (fresh.total, fresh.starts, fresh.nodes.tolist())
        assert tree.total == len(library.encode(tree.text, add_special_tokens=False).ids)


def test_count_rows(spark, docs, empty, rows):
    edits = spark.createDataFrame([(1, 0, 0, 3, "new "), (1, 1, 10, None, None), (None, 0, 0, 0, "x"), (13, 0, 900, 905, "")], "doc_id long, step int, start long, end long, new string")
    got = token_counts.count_tokens(docs, BYTE, edits).collect()
    assert len(got) == len(rows) and token_counts.count_tokens(empty, BYTE).count() == 0
    library = Tokenizer.from_file(BYTE)
    long = next(r for r in got if r["doc_id"] == 13)
    text = next(t for i, t, *_ in rows if i == 13)
    assert long["n_tokens"] == len(library.encode(text).ids) and long["n_tokens_edited"] == len(library.encode(text[:900] + text[905:]).ids)
    assert long["n_reencoded"] < 20


@settings(max_examples=100, deadline=None, database=None)
@given(st.lists(st.sampled_from([0, 1, 2, 300, 50256, 65535]) | st.integers(0, 65535), max_size=400))
def test_block_round_trip(ids):
    assert mixcoder.decode_block(mixcoder.encode_block(np.array(ids, np.int64))).tolist() == ids


@pytest.mark.parametrize(("n", "distinct"), [(64, 1), (65, 70), (5_000, 3), (300_000, 1), (300_000, 400), (70_000, 65_536)])
def test_large_blocks(n, distinct):
    ids = np.random.default_rng(n).integers(0, distinct, n)
    code = mixcoder.encode_block(ids)
    assert (mixcoder.decode_block(code) == ids).all()
    assert distinct > 400 or len(code) * 8 < n * (math.log2(distinct) + 1) + 20_000


def test_what_follows_before_is_cheap():
    draw = np.random.default_rng(1)
    chain = draw.permutation(5000)
    ids = np.zeros(200_000, np.int64)
    for k in range(1, len(ids)):
        ids[k] = chain[ids[k - 1]] if draw.random() < 0.9 else draw.integers(5000)
    assert len(mixcoder.encode_block(ids)) * 8 < 5 * len(ids)  # 12.3 bits without a context


def test_damaged_block():
    whole = mixcoder.encode_block(np.arange(500) % 77)
    found = 0
    for at in range(4, len(whole)):
        block = bytearray(whole)
        block[at] ^= 4
        try:
            assert (mixcoder.decode_block(bytes(block)) == np.arange(500) % 77).all()  # what lies behind the last id
        except ValueError:
            found += 1
    assert found > 0.95 * (len(whole) - 4)
    for n in (0, 3, 11, 20, len(whole) - 2):
        with pytest.raises(ValueError):
            mixcoder.decode_block(whole[:n])
    for ids in ([1, 65536], [-1]):
        with pytest.raises(ValueError):
            mixcoder.encode_block(np.array(ids))


@pytest.mark.parametrize("block", [mixcoder.BLOCK, 1000])
def test_token_files(spark, docs, empty, rows, block):
    library = Tokenizer.from_file(BYTE)
    got = token_files.read_index(spark, token_files.write(docs, BYTE, end=2, block=block)).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows if i is not None)) + [None] * 3
    want = sorted(zlib.crc32(np.array([*library.encode(t or "").ids, 2], "<u4").tobytes()) for _, t, *_ in rows)
    assert sorted(r["ids_crc32"] for r in got) == want  # the long text spans small blocks
    assert token_files.read_index(spark, token_files.write(empty, BYTE, end=2)).count() == 0

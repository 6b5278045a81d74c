"""The registered queries of this subpackage: thin callers of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, infill, langid, neighbours, pii, repeats, sharding, simhash, spelling, token_counts, token_files


OP2 = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha256(body) AS text_sha256,
       n_points
FROM t
WINDOW g AS (PARTITION BY body ORDER BY n_points DESC, doc_id NULLS LAST)
"""


OP3 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), wins AS (
    SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase
    FROM b WHERE len(w) > 0
), grams AS (
    SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) s) s
), met AS (
    SELECT DISTINCT doc_id, i, grams.n, item FROM grams JOIN wins ON grams.n = wins.n AND grams.phrase = wins.phrase
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), toks AS (
    SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d
), places AS (
    SELECT phrase, len(t) AS n, unnest(t) AS term, unnest(range(0, len(t))) AS off FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS t FROM wins)
), rarest AS (
    SELECT phrase, n, arg_min(term, {'df': coalesce(df, 0), 'off': off}) AS term, arg_min(off, {'df': coalesce(df, 0), 'off': off}) AS off
    FROM places LEFT JOIN (SELECT term, count(*) AS df FROM toks GROUP BY term) USING (term) GROUP BY phrase, n
), starts AS (
    SELECT DISTINCT doc_id, phrase, n, p - off + shift AS start FROM rarest JOIN toks USING (term), (SELECT unnest(range(-2, 3)) AS shift) WHERE p - off + shift >= 0
), near AS (
    SELECT DISTINCT doc_id, phrase FROM (
        SELECT s.doc_id, s.phrase, s.start FROM starts s JOIN places x USING (phrase) JOIN toks t ON t.doc_id = s.doc_id AND t.term = x.term AND t.p BETWEEN s.start + x.off - 2 AND s.start + x.off + 2
        GROUP BY s.doc_id, s.phrase, s.start, s.n HAVING count(DISTINCT x.off) = s.n
    )
), nears AS (
    SELECT doc_id, count(*) AS n_near FROM near WHERE (doc_id, phrase) NOT IN (SELECT doc_id, grams.phrase FROM grams JOIN wins ON grams.n = wins.n AND grams.phrase = wins.phrase) GROUP BY doc_id
), ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


OP5 = """
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), pieces AS (
    SELECT row, low, array_slice(x, 2 * low + 1, 2 * low + 1600) AS piece FROM (SELECT row, x, unnest(range(0, length(x) // 2 - 399, 400)) AS low FROM d)
), starts AS (
    SELECT row, low, piece, unnest(range(0, least(length(piece) // 2 - 399, 400))) AS i FROM pieces
), strings AS (
    SELECT row, low + i AS p, md5_number(array_slice(piece, 2 * i + 1, 2 * i + 800)) AS h FROM starts
), often AS (
    SELECT h FROM strings GROUP BY h HAVING count(*) > 1
), hit AS (
    SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS before FROM strings SEMI JOIN often USING (h)
), spans AS (
    SELECT row, min(p) AS low, max(p) + 400 AS high FROM (
        SELECT row, p, count(*) FILTER (before IS NULL OR p > before + 400) OVER (PARTITION BY row ORDER BY p) AS span FROM hit
    ) GROUP BY row, span
), gaps AS (
    SELECT row, high, low, coalesce(lag(high) OVER (PARTITION BY row ORDER BY low), 0) AS since FROM spans
), kept AS (
    SELECT row, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS done, string_agg(array_slice(x, 2 * since + 1, 2 * low), '' ORDER BY low) AS parts
    FROM gaps JOIN d USING (row) GROUP BY row
)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(parts, '') || array_slice(x, 2 * coalesce(done, 0) + 1, length(x)))) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""


#: list_distance sums in an order of its own, so the sum is written out.
OP11 = """
WITH e AS (
    SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), ok AS (
    SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), met AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(q.v, lambda x, i: (x - c.v[i]) * (x - c.v[i]))), lambda a, b: a + b)) AS score FROM ok q JOIN ok c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id) AS rank FROM met
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


OP12 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), u AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform(range(0, 4), lambda k: CAST('0x' || substring(s, 8 * k + 1, 8) AS BIGINT)) AS h FROM d
), c AS (
    SELECT *, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b FROM u
), p AS (
    SELECT doc_id, t, n, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


#: crc32 bit by bit as its definition goes, since DuckDB has none; near words by patterns and by deletions.
OP13 = """
WITH runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), tab AS (
    SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), each AS (
    SELECT name, run, count(*) AS m, hex(encode(name || ':' || run)) AS x FROM runs GROUP BY name, run
), hashed AS (
    SELECT run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda k: CAST('0x' || substring(x, k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM each, tab
), w AS (
    SELECT word, CAST(sum(m) AS BIGINT) AS n
    FROM (SELECT m, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5
), cuts AS (
    SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN w ON c.less = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN w ON c.less = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, {'a': -n, 'b': other}) AS other FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)
), chain AS (
    WITH RECURSIVE c AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT c.word, c.root FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""


#: What SQL can say of op9 and op10: the base kinds by their counts, and what each row brings to its shard.
PII_COUNTS = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
    SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
           regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
           list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: list_reverse(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''))) AS cards,
           list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones
    FROM d
)
SELECT doc_id, n_email,
       len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(CASE WHEN length(ltrim(y, '0')) > 3 THEN '999' ELSE y END AS INTEGER))) <= 255)) AS n_ip,
       len(list_filter(cards, lambda c: len(c) BETWEEN 16 AND 19 AND list_sum(list_transform(c, lambda y, i: CASE WHEN i % 2 = 1 THEN CAST(y AS INTEGER) WHEN CAST(y AS INTEGER) > 4 THEN 2 * CAST(y AS INTEGER) - 9 ELSE 2 * CAST(y AS INTEGER) END)) % 10 = 0)) AS n_card,
       len(list_filter(phones, lambda n: n BETWEEN 8 AND 15)) AS n_phone
FROM found
"""
SHARD_ROWS = "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, 'bytes' AS law FROM documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir)).drop("h")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(_documents(spark, sf_dir), items, width=10, slack=2)


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), path or public_tokenizers.path("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir), width=400, with_kept=False).drop("removed")


def op6_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Counts of every document, and after one edit of each: a word put in at the middle code point."""
    half = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2)
    edits = F.array(F.struct(F.lit(0).alias("step"), half.alias("start"), half.alias("end"), F.lit(" and ").alias("new")))
    return token_counts.count_tokens(_documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_50k.json"), edits)


def op7_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = token_files.write(_documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_files.read_index(spark, folder)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir), words=3, bits=2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=24)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=24).select("doc_id", "size", "law")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_exact_dedup, op3_decontamination, op4_bpe, op5_suffix_dedup, op6_token_counts, op7_token_files, op8_simhash_near_dedup, op9_pii, op10_sharding, op11_nearest, op12_fill_in_middle, op13_spelling_variants, pii_counts, shard_rows, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_decontamination": OP3, "op5_suffix_dedup": OP5, "op11_nearest": OP11, "op12_fill_in_middle": OP12, "op13_spelling_variants": OP13, "pii_counts": PII_COUNTS, "shard_rows": SHARD_ROWS}

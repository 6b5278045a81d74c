"""The same queries as plain DuckDB SQL, written from the semantics and not from the operators."""

from __future__ import annotations

from ..functions.ranks import RANKS
from . import emulation as E


def _d(text: str) -> str:
    return text.replace(" DIV ", " // ")


_LEVELS = "\n    UNION ".join(
    f"SELECT CAST({_d(t)} AS BIGINT) AS taxid, CAST({_d(p)} AS BIGINT) AS parent, {_d(r)} AS rank FROM (SELECT p_partkey AS p FROM part) WHERE {_d(w)}" for t, p, r, w in E.LEVELS
)
_CANON_RANK = """CASE WHEN regexp_matches(rank, '^(super|sub|infra|parv)?(domain|superkingdom|kingdom)$') THEN 'superkingdom'
         ELSE nullif(regexp_extract(rank, '^(?:super|sub|infra|parv)?(phylum|class|order|family|genus|species|strain)$', 1), '') END"""
_EXACT_RANK = f"CASE WHEN rank = 'kingdom' THEN 'superkingdom' WHEN rank IN ({', '.join(f"'{r}'" for r in RANKS)}) THEN rank END"
_INDEX = "coalesce(list_position([" + ", ".join(f"'{r}'" for r in RANKS) + "], {}), 0) - 1"

_CTES = {
    "lines": f"""SELECT l_orderkey AS key, 'r' || l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(E.ORDER)}) AS n,
        CASE WHEN l_returnflag = 'A' THEN NULL ELSE {E.TAXID} END AS taxid, CAST(l_quantity AS BIGINT) AS cnt FROM lineitem""",
    "reads": f"""SELECT 'r' || o_orderkey AS id, o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'U' ELSE 'C' END AS classified,
        'Taxon (taxid ' || ({E.REPORTED}) || ')' AS taxonomy, CAST({E.REPORTED} AS BIGINT) AS reported, CAST(100 + o_orderkey % 900 AS INTEGER) AS length,
        (SELECT count(*) FROM lines l WHERE l.key = o_orderkey) > 0 AS has FROM orders""",
    "all_runs": "SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS ord, taxid, cnt FROM lines WHERE taxid IS NOT NULL",
    "runs": "SELECT r.* FROM all_runs r JOIN reads USING (key) WHERE classified = 'C'",
    "placed": "SELECT *, CAST(coalesce(sum(cnt) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM runs",
    "bins": f"""SELECT id, bin, taxid, CAST(sum(least(start + cnt, (bin + 1) * {E.BIN}) - greatest(start, bin * {E.BIN})) AS BIGINT) AS cnt
        FROM (SELECT *, unnest(range(start // {E.BIN}, (start + cnt - 1) // {E.BIN} + 1)) AS bin FROM placed) GROUP BY ALL""",
    "nodes": f"SELECT 1 AS taxid, 1 AS parent, 'no rank' AS rank\n    UNION {_LEVELS}",
    "named": f"SELECT taxid, parent, rank, rank || ' ' || taxid AS name, {_CANON_RANK} AS canonical, {_EXACT_RANK} AS exact FROM nodes",
    "merged": "SELECT 9000000 + p_partkey AS old, 1000000 + p_partkey AS new FROM part WHERE p_partkey % 17 = 0",
    "taxids": "SELECT taxid FROM all_runs WHERE taxid <> 0 UNION SELECT new FROM merged UNION SELECT reported FROM reads",
    "up": """SELECT t.taxid, n.taxid AS anc, n.parent, 0 AS up FROM taxids t LEFT JOIN merged ON t.taxid = old JOIN nodes n ON n.taxid = coalesce(new, t.taxid)
        UNION ALL SELECT u.taxid, n.taxid, n.parent, u.up + 1 FROM up u JOIN nodes n ON n.taxid = u.parent WHERE u.parent <> u.anc""",
    "lineage": "SELECT taxid, CAST(max(up) OVER (PARTITION BY taxid) - up AS INTEGER) AS depth, anc FROM up",
    "canon": "SELECT l.taxid, " + ", ".join(f"arg_min(anc, depth) FILTER (canonical = '{r}') AS c{k}" for k, r in enumerate(RANKS)) + " FROM lineage l JOIN named ON named.taxid = anc GROUP BY l.taxid",
    "outs": "SELECT l.taxid, " + ", ".join(f"arg_max(anc, depth) FILTER (exact = '{r}') AS o{k}" for k, r in enumerate(RANKS)) + " FROM lineage l JOIN named ON named.taxid = anc GROUP BY l.taxid",
    "support": """SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, first_ord) AS pos
        FROM (SELECT id, any_value(key) AS key, taxid, CAST(sum(cnt) AS BIGINT) AS total, min(ord) AS first_ord FROM runs WHERE taxid <> 0 GROUP BY id, taxid)""",
    "cands": """SELECT id, key, s.taxid, coalesce(new, s.taxid) AS taxon, total, pos FROM support s LEFT JOIN merged ON old = s.taxid
        WHERE coalesce(new, s.taxid) IN (SELECT taxid FROM lineage)""",
    "truth": "SELECT id, key, classified, CASE WHEN key % 3 = 0 THEN reported ELSE reported END AS true_taxon FROM reads",
    "pairs": "SELECT c.*, true_taxon FROM cands c JOIN truth USING (id) WHERE true_taxon IN (SELECT taxid FROM lineage)",
    "labels": "SELECT p.id, p.taxon, p.taxid, true_taxon, " + ", ".join(f"CAST(coalesce(a.c{k} = t.c{k}, false) AS INTEGER) AS label{k}" for k in range(7))
    + " FROM pairs p LEFT JOIN canon a ON a.taxid = p.taxon LEFT JOIN canon t ON t.taxid = true_taxon",
    "scored": "SELECT id, taxon, pos, " + ", ".join(f"{p} AS p{k}" for k, p in enumerate(E.PROBABILITIES)) + " FROM (SELECT *, key AS k FROM cands)",
    "labelled": "SELECT source AS head, (n_chars % 97) / 97.0::DOUBLE AS score, quality AS y, doc_id AS pos FROM documents JOIN labels_table USING (doc_id)",
    "shards": "SELECT CAST(l_suppkey % 20 AS INTEGER) AS shard, count(*) AS n FROM lineitem GROUP BY ALL",
    "offs": "SELECT shard, n, CAST(coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM shards",
}
# the labels CTE would hide the table of that name
_CTES["pair_labels"] = _CTES.pop("labels")
_CTES["labelled"] = _CTES["labelled"].replace("labels_table", "labels")


def _with(final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in _CTES.items()) + f"\n{final}"


def _named(prefix: str, to: str) -> str:
    return ", ".join(f"{prefix}{k} AS {to}{r}" for k, r in enumerate(RANKS))


def _coalesced(parts: list[str]) -> str:
    return "coalesce(" + ", ".join(parts) + ")"


def _select(tie_break: str, prefer: bool = False, strict: bool = False, extra: str = "") -> str:
    """CTEs up to ``best``: the selected candidate of each read."""
    near = lambda x, m: f"abs({x} - {m}) <= 1e-15 + 1e-12 * abs({m})"
    case = lambda f: "CASE r " + " ".join(f"WHEN {k} THEN {f(k)}" for k in range(7)) + " END"
    added = lambda ks: " + ".join(f"coalesce(p{k}, 0.0)" for k in ks) or "0.0"
    source = "SELECT * FROM (SELECT *, max(taxon % 3 = 0) OVER (PARTITION BY id) AS any_in FROM scored) WHERE NOT any_in OR taxon % 3 = 0" if prefer else "SELECT * FROM scored"
    passed = [f"CASE WHEN m{k} >= 0.5 THEN {k} END" for k in range(6, -1, -1)]
    finite = [] if strict else [f"CASE WHEN m{k} IS NOT NULL THEN {k} END" for k in range(6, -1, -1)]
    steps = [
        ("t0", source),
        ("t1", "SELECT *, " + ", ".join(f"max(p{k}) OVER (PARTITION BY id) AS m{k}" for k in range(7)) + " FROM t0"),
        ("t2", f"SELECT *, {_coalesced(passed + finite)} AS r FROM t1"),
        ("t3", f"SELECT *, {case(lambda k: f'p{k}')} AS p, {case(lambda k: f'm{k}')} AS m FROM t2"),
        ("t4", f"SELECT *, coalesce({near('p', 'm')}, false) AS tie, {case(lambda k: added(range(k + 1)))} AS s, {case(lambda k: added(range(k + 1, 7)))} AS e FROM t3"),
        ("t5", "SELECT *, max(CASE WHEN tie THEN s END) OVER (PARTITION BY id) AS ms FROM t4"),
        ("t6", f"SELECT *, tie AND {near('s', 'ms')} AS tie2 FROM t5"),
        ("t7", "SELECT *, max(CASE WHEN tie2 THEN e END) OVER (PARTITION BY id) AS me FROM t6"),
        ("t8", f"SELECT *, tie2 AND {near('e', 'me')} AS tie3 FROM t7"),
    ]
    flag = {"p_only": "tie", "sum_to_rank": "tie2", "deep_then_sum": "tie3"}[tie_break]
    rank = "CASE r " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(RANKS)) + " END"
    steps.append(("best", f"SELECT *, {rank} AS chosen_rank, p AS chosen_prob FROM t8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce({flag}, false) DESC, pos) = 1"))
    return ",\n".join(f"{a} AS ({b})" for a, b in steps) + extra


def _chosen(*args, final: str = "SELECT id, taxon, pos, chosen_rank, chosen_prob FROM best", **kw) -> str:
    return _with("").rstrip() + ",\n" + _select(*args, **kw) + f"\n{final}"


_REFINED = "SELECT r.id, classified, taxonomy, length, reported AS reported_taxid, final_taxid, named.name AS final_name, chosen_rank, chosen_prob, " + ", ".join(
    f"format('{{:.6f}}', p{k}) AS prob_{r}" for k, r in enumerate(RANKS)
) + f""" FROM reads r LEFT JOIN (SELECT best.*, CASE WHEN chosen_rank IS NOT NULL THEN coalesce(CASE r {' '.join(f'WHEN {k} THEN o{k}' for k in range(7))} END, taxon) END AS final_taxid
    FROM best LEFT JOIN outs ON outs.taxid = taxon) b ON b.id = r.id LEFT JOIN named ON named.taxid = final_taxid"""

_OUTCOME = """SELECT CASE WHEN classified = 'C' AND coalesce(taxon IN (SELECT anc FROM lineage l WHERE l.taxid = true_taxon), false) THEN 'TP' WHEN classified = 'C' THEN 'FP'
    WHEN key % 3 = 0 THEN 'FN' WHEN key % 3 = 1 THEN 'TN' ELSE 'OTHER' END AS outcome, count(*) AS n
    FROM truth LEFT JOIN (SELECT id, taxon FROM best) USING (id) GROUP BY ALL"""

_FEATURES = """, sizes AS (SELECT id, bin, sum(cnt) AS size FROM bins GROUP BY ALL),
want AS (SELECT DISTINCT id, taxon FROM pairs),
cells AS (SELECT w.id, w.taxon, b.bin, b.taxid, b.cnt, """ + ", ".join(
    f"CASE WHEN pc.c{k} IS NULL OR kc.c{k} IS NULL OR pc.c{k} <> kc.c{k} THEN 'out' WHEN b.taxid = pc.c{k} OR coalesce(kn.canonical = '{r}', false) THEN 'in' ELSE 'desc' END AS f{k}" for k, r in enumerate(RANKS)
) + """ FROM want w JOIN bins b ON b.id = w.id LEFT JOIN canon pc ON pc.taxid = w.taxon LEFT JOIN canon kc ON kc.taxid = b.taxid LEFT JOIN named kn ON kn.taxid = b.taxid),
feats AS (SELECT id, taxon, bin AS bin_no, sum(CASE WHEN taxid = taxon THEN cnt ELSE 0 END)::DOUBLE / sum(cnt)::DOUBLE AS exact, """ + ", ".join(
    f"sum(CASE WHEN f{k} = '{c}' THEN cnt ELSE 0 END)::DOUBLE / sum(cnt)::DOUBLE AS {r}_{c}" for k, r in enumerate(RANKS) for c in ("in", "out", "desc")
) + " FROM cells GROUP BY id, taxon, bin)"

_CURVE = """, steps AS (SELECT head, score, y, pos, row_number() OVER w AS k, sum(y) OVER w AS tp, row_number() OVER w AS seen, sum(y) OVER (PARTITION BY head) AS p, count(*) OVER (PARTITION BY head) AS n
    FROM labelled WINDOW w AS (PARTITION BY head ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING))"""
_PR = _CURVE + ", pr AS (SELECT head, k, tp::DOUBLE / greatest(p, 1)::DOUBLE AS recall, tp::DOUBLE / seen::DOUBLE AS prec FROM steps)"
_MERGED = """, cells AS (SELECT head, score, sum(y) AS y1, count(*) AS n1 FROM labelled GROUP BY ALL),
steps AS (SELECT *, sum(y1) OVER w AS tp, sum(n1) OVER w AS seen, sum(y1) OVER (PARTITION BY head) AS p, sum(n1) OVER (PARTITION BY head) AS n
    FROM cells WINDOW w AS (PARTITION BY head ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_X = "(score * 8 - 4)"
_BCE = f"(greatest({_X}, 0.0) - {_X} * y + ln(1.0 + exp(-abs({_X}))))"
_HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
_RATES = """CASE WHEN tp + fp > 0 THEN fp::DOUBLE / (tp + fp) END AS false_assignment, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END AS specificity, CASE WHEN tn + fp > 0 THEN fp::DOUBLE / (tn + fp) END AS fpr, (2 * tp)::DOUBLE / greatest(2 * tp + fp + fn, 1) AS f1"""
_ISO = """, points AS (SELECT head, round(score, 6) AS x, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM labelled WHERE y IN (0, 1) GROUP BY ALL),
cum AS (SELECT head, x, row_number() OVER w AS k, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM points WINDOW w AS (PARTITION BY head ORDER BY x ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT * FROM cum UNION ALL SELECT DISTINCT head, NULL, 0, 0.0, 0.0 FROM cum),
spans AS (SELECT a.head, a.k AS lo, b.k AS hi, (b.cs - a.cs) / (b.cn - a.cn) AS mean FROM ends a JOIN ends b ON a.head = b.head AND a.k < b.k),
least_ AS (SELECT p.head, p.k, s.lo, min(s.mean) AS m FROM cum p JOIN spans s ON s.head = p.head AND s.lo < p.k AND s.hi >= p.k GROUP BY ALL),
fitted AS (SELECT p.head, p.k, any_value(p.x) AS x, max(m) AS y FROM cum p JOIN least_ USING (head, k) GROUP BY ALL)"""
_READS = """, climbed AS (SELECT taxid, taxid AS anc FROM nodes UNION SELECT c.taxid, n.parent FROM climbed c JOIN nodes n ON n.taxid = c.anc),
truth2 AS (SELECT 1000000 + s_suppkey * 5 AS true_taxid, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'included/a' WHEN 1 THEN 'excluded/b' ELSE 'other' END AS path FROM supplier),
told AS (SELECT r.id, classified, path, reported AS taxid, true_taxid, CASE WHEN classified = 'C' AND coalesce(reported IN (SELECT anc FROM climbed c WHERE c.taxid = true_taxid), false) THEN 'TP' WHEN classified = 'C' THEN 'FP'
    WHEN path LIKE 'included%' THEN 'FN' WHEN path LIKE 'excluded%' THEN 'TN' ELSE 'OTHER' END AS outcome, CASE WHEN n.rank IN ('superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species') THEN n.rank END AS call_rank,
    round(p6, 9) AS prob_species
    FROM reads r JOIN truth2 ON r.key % 40 = s_suppkey AND r.key % 10 <> 9 LEFT JOIN nodes n ON n.taxid = reported LEFT JOIN (SELECT DISTINCT id, taxon, p6 FROM scored) p ON p.id = r.id AND p.taxon = reported)"""
_SEED = "md5('{}|' || shard)"

ORACLE: dict[str, str] = {
    "q_scan_classified": _with("SELECT id, taxonomy, length FROM reads WHERE classified = 'C' AND has"),
    "q_parse_kmers": _with("""SELECT r.id, count(l.n)::INTEGER AS n_tokens, coalesce(string_agg(coalesce(taxid::VARCHAR, 'A') || ':' || cnt, ';' ORDER BY n), '') AS tokens
        FROM reads r LEFT JOIN lines l USING (key) GROUP BY r.id"""),
    "q_tokens": _with("SELECT id, ord::INTEGER AS ord, taxid, cnt FROM all_runs"),
    "q_tax_counts": _with("SELECT id, taxid, CAST(sum(cnt) AS BIGINT) AS cnt FROM all_runs GROUP BY ALL"),
    "q_distinct_taxa": _with("SELECT DISTINCT taxid FROM all_runs"),
    "q_taxid_parse": _with("SELECT id, coalesce(new, reported) AS taxid, reported FROM reads LEFT JOIN merged ON old = reported"),
    "q_true_taxon": _with("SELECT id, true_taxon FROM truth"),
    "q_accession": """SELECT s_suppkey, 'GCF_' || s_suppkey || '.' || left((s_suppkey % 30)::VARCHAR, 1) AS accession, 'g' || s_nationkey AS genome_key, s_suppkey + 5 AS genome_taxid FROM supplier""",
    "q_positions": _with("SELECT id, ord::INTEGER AS ord, taxid, cnt, start FROM placed"),
    "q_bins": _with("SELECT * FROM bins"),
    "q_bin_downsample": _with("""SELECT b.* FROM bins b JOIN (SELECT id, bin, row_number() OVER (PARTITION BY id ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, bin FROM bins)) s
        USING (id, bin) WHERE n <= 3 OR k IN (0, n // 3, 2 * n // 3)"""),
    "q_lineage": _with("SELECT * FROM lineage"),
    "q_canonical": _with(f"SELECT taxid, {_named('c', 'c_')} FROM canon"),
    "q_output_ranks": _with(f"SELECT taxid, {_named('o', 'o_')} FROM outs"),
    "q_tour": _with("""SELECT taxid, first, first + below AS last, depth, below, leaves
        FROM (SELECT w.taxid, row_number() OVER (ORDER BY path) AS first, depth, coalesce(n_all, 0) AS below, coalesce(n_leaves, 0) AS leaves FROM walk w
        LEFT JOIN (SELECT anc, count(*) AS n_all, count(*) FILTER (taxid NOT IN (SELECT parent FROM nodes WHERE parent <> taxid)) AS n_leaves FROM (SELECT DISTINCT * FROM below) GROUP BY anc) b ON b.anc = w.taxid)""")
        .replace("lineage AS (", "below AS (SELECT taxid, parent AS anc FROM nodes WHERE parent <> taxid UNION SELECT b.taxid, n.parent FROM below b JOIN nodes n ON n.taxid = b.anc WHERE n.parent <> n.taxid),\nwalk AS (SELECT taxid, [taxid] AS path, 0 AS depth FROM nodes WHERE parent = taxid UNION ALL SELECT n.taxid, list_append(path, n.taxid), depth + 1 FROM walk w JOIN nodes n ON n.parent = w.taxid AND n.taxid <> w.taxid),\nlineage AS (", 1),
    "q_leaf_species": _with("""SELECT DISTINCT anc AS taxid, b.taxid AS descendant FROM below b JOIN nodes f ON f.taxid = b.anc AND f.rank = 'family'
        WHERE b.taxid NOT IN (SELECT parent FROM nodes WHERE parent <> taxid)""").replace("lineage AS (", "below AS (SELECT taxid, parent AS anc FROM nodes WHERE parent <> taxid UNION SELECT b.taxid, n.parent FROM below b JOIN nodes n ON n.taxid = b.anc),\nlineage AS (", 1),
    "q_clade_support": _with("""SELECT c.id, CAST(sum(cnt) AS BIGINT) AS total, CAST(coalesce(sum(cnt) FILTER (l.anc IS NOT NULL), 0) AS BIGINT) AS in_clade
        FROM (SELECT id, coalesce(new, taxid) AS taxon, sum(cnt) AS cnt FROM runs LEFT JOIN merged ON old = taxid WHERE taxid <> 0 GROUP BY ALL) c
        JOIN (SELECT id, coalesce(new, reported) AS rep FROM reads LEFT JOIN merged ON old = reported WHERE classified = 'C') o USING (id)
        JOIN nodes a ON a.taxid = taxon JOIN nodes b ON b.taxid = rep LEFT JOIN (SELECT DISTINCT taxid, anc FROM lineage) l ON l.taxid = taxon AND l.anc = rep GROUP BY c.id"""),
    "q_described": _with("""SELECT t.taxid, coalesce(any_value(rank), 'no_rank') AS rank, coalesce(string_agg(anc::VARCHAR, ',' ORDER BY depth), '') AS path
        FROM (SELECT taxid FROM taxids UNION SELECT 8000000 + p_partkey FROM part) t LEFT JOIN lineage l USING (taxid) LEFT JOIN merged ON old = t.taxid LEFT JOIN nodes n ON n.taxid = coalesce(new, t.taxid) GROUP BY t.taxid"""),
    "q_exclusions": _with("""SELECT id, world, cutoff, CAST(list_position(['superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species'], cutoff) - 1 AS INTEGER) AS cutoff_index, level <> 'none' AS is_excluded, level
        FROM (SELECT *, CASE level WHEN 'species' THEN 'genus' WHEN 'genus' THEN 'family' WHEN 'family' THEN 'order' ELSE 'species' END AS cutoff FROM (
            SELECT id, world, CASE WHEN world = 'S' AND s.taxid IS NOT NULL THEN 'species' WHEN world = 'G' AND g.taxid IS NOT NULL THEN 'genus' WHEN world = 'F' AND f.taxid IS NOT NULL THEN 'family' ELSE 'none' END AS level
            FROM (SELECT id, ['CORE', 'S', 'G', 'F', 'other'][key % 5 + 1] AS world, coalesce(new, reported) AS taxon FROM reads LEFT JOIN merged ON old = reported WHERE classified = 'C' AND has) r
            LEFT JOIN canon c ON c.taxid = r.taxon LEFT JOIN nodes s ON s.taxid = c6 AND s.rank = 'species' AND s.taxid % 3 = 0
            LEFT JOIN nodes g ON g.taxid = c5 AND g.rank = 'genus' AND g.taxid % 3 = 0 LEFT JOIN nodes f ON f.taxid = c4 AND f.rank = 'family' AND f.taxid % 3 = 0))"""),
    "q_descendants": _with("""SELECT anc AS taxid, count(*) AS n_all, count(*) FILTER (taxid NOT IN (SELECT parent FROM nodes WHERE parent <> taxid)) AS n_leaves
        FROM (SELECT DISTINCT * FROM below) WHERE anc <> taxid GROUP BY anc""").replace("lineage AS (", "below AS (SELECT taxid, parent AS anc FROM nodes WHERE parent <> taxid UNION SELECT b.taxid, n.parent FROM below b JOIN nodes n ON n.taxid = b.anc),\nlineage AS (", 1),
    "q_rank_canon": _with(f"SELECT taxid, rank, name, canonical, exact, CAST({_INDEX.format('canonical')} AS INTEGER) AS rank_index FROM named"),
    "q_candidates": _with("SELECT id, taxid, taxon, total, pos::INTEGER AS pos FROM cands"),
    "q_topk_training": _with("""SELECT id, taxid, pos::INTEGER AS pos, CASE WHEN pos <= 1 THEN 'top' WHEN draw <= 1 THEN 'extra' ELSE 'reported' END AS why
        FROM (SELECT s.*, row_number() OVER (PARTITION BY s.id, pos > 1 ORDER BY md5('0|' || s.id || '|' || taxid), pos) AS draw, r.reported FROM support s JOIN reads r USING (id))
        WHERE pos <= 1 OR draw <= 1 OR taxid = reported"""),
    "q_labels": _with(f"SELECT id, taxon, true_taxon, {_named('label', 'label_')} FROM pair_labels"),
    "q_cutoff_targets": """SELECT p_partkey, cutoff, array_to_string(list_transform(range(7), lambda i: (i <= cutoff)::INTEGER), ',') AS targets,
        array_to_string(list_transform(range(7), lambda i: (i <= cutoff)::INTEGER), ',') AS from_eight,
        array_to_string(list_transform(range(7), lambda i: CASE WHEN i > 4 THEN -1 ELSE (i <= cutoff)::INTEGER END), ',') AS from_five,
        CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE 3 END AS remapped
        FROM (SELECT p_partkey, CASE WHEN p_partkey // 16 % 5 = 2 THEN 3 WHEN p_partkey // 4 % 5 = 1 THEN 4 WHEN p_partkey % 5 = 0 THEN 5 ELSE 6 END AS cutoff FROM part)""",
    "q_bin_features": _with("").rstrip() + _FEATURES + "\nSELECT * FROM feats",
    "q_feature_rows": _with("").rstrip() + _FEATURES + "\nSELECT id, taxon, count(*)::INTEGER AS n_bins, arg_min(exact, bin_no)::FLOAT::DOUBLE AS first_exact, 22 AS n_channels, md5(string_agg(" + " || ',' || ".join(
        f"CAST(floor({c}::FLOAT::DOUBLE * 100000 + 0.25) AS BIGINT)" for c in ("exact", *(f"{r}_{x}" for r in RANKS for x in ("in", "out", "desc")))
    ) + ", ',' ORDER BY bin_no)) AS digest FROM feats GROUP BY id, taxon",
    "q_pad_mask": _with("""SELECT id, len(own)::INTEGER AS length, array_to_string(list_concat(cut, list_transform(range(8 - len(cut)), lambda i: -1)), ',') AS padded,
        repeat('1', least(len(own), 8)) || repeat('0', greatest(8 - len(own), 0)) AS mask
        FROM (SELECT *, own[least(2, greatest(len(own) - 8, 0)) + 1 : least(2, greatest(len(own) - 8, 0)) + 8] AS cut FROM (SELECT id, list(DISTINCT bin ORDER BY bin) AS own FROM bins GROUP BY id))"""),
    "q_resample": """SELECT vec_id, j::INTEGER AS j, round(a + (b - a) * (x - lo), 9) AS value FROM (SELECT vec_id, j, x, lo, embedding[lo + 1]::DOUBLE AS a, embedding[least(lo + 1, n - 1) + 1]::DOUBLE AS b
        FROM (SELECT *, least(floor(x)::INTEGER, greatest(n - 2, 0)) AS lo FROM (SELECT vec_id, embedding, len(embedding) AS n, j, j * (len(embedding) - 1) / 99 AS x FROM (SELECT *, unnest(range(100)) AS j FROM embeddings))))""",
    "q_pool": """SELECT vec_id, round(coalesce(sum(v) FILTER (v > 0), 0.0) / greatest(count(*) FILTER (v > 0), 1e-6), 9) AS pooled FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id""",
    "q_select_best": _chosen("sum_to_rank"),
    "q_select_p_only": _chosen("p_only"),
    "q_select_deep": _chosen("deep_then_sum"),
    "q_select_lineage": _chosen("sum_to_rank", prefer=True),
    "q_select_strict": _chosen("sum_to_rank", strict=True),
    "q_refined_calls": _chosen("sum_to_rank", final=_REFINED),
    "q_auroc": _with("").rstrip() + _CURVE + """
SELECT head, CASE WHEN max(p) = 0 OR max(p) = max(n) THEN 0.5 ELSE sum((1 - y) * (2 * tp - y))::DOUBLE / (2 * max(p) * (max(n) - max(p)))::DOUBLE END AS auroc FROM steps GROUP BY head""",
    "q_auroc_merged": _with("").rstrip() + _MERGED + """
SELECT head, CASE WHEN max(p) = 0 OR max(p) = max(n) THEN 0.5 ELSE sum((n1 - y1) * (2 * tp - y1))::DOUBLE / (2 * max(p) * (max(n) - max(p)))::DOUBLE END AS auroc FROM steps GROUP BY head""",
    "q_aupr": _with("").rstrip() + _PR + """
SELECT head, round(sum((recall - r0) * (prec + p0) / 2), 9) AS aupr FROM (SELECT *, lag(recall, 1, 0.0) OVER w AS r0, lag(prec, 1, 1.0) OVER w AS p0 FROM pr WINDOW w AS (PARTITION BY head ORDER BY k)) GROUP BY head""",
    "q_pr_curve": _with("").rstrip() + _PR + "\nSELECT head, k::INTEGER AS k, recall, prec FROM pr",
    "q_confusion": _with(f"""SELECT *, {_RATES} FROM (SELECT head, count(*) FILTER (score > 0.5 AND y = 1) AS tp, count(*) FILTER (score > 0.5 AND y <> 1) AS fp,
        count(*) FILTER (score <= 0.5 AND y = 1) AS fn, count(*) FILTER (score <= 0.5 AND y <> 1) AS tn FROM labelled GROUP BY head)"""),
    "q_best_f1": _with("""SELECT head, CASE WHEN f1 > 0 THEN t / 100::DOUBLE ELSE 0.5 END AS threshold, f1 FROM (SELECT head, t, (2 * tp)::DOUBLE / greatest(2 * tp + fp + fn, 1) AS f1 FROM (
        SELECT head, t, count(*) FILTER (score > t / 100::DOUBLE AND y = 1) AS tp, count(*) FILTER (score > t / 100::DOUBLE AND y = 0) AS fp, count(*) FILTER (NOT score > t / 100::DOUBLE AND y = 1) AS fn
        FROM labelled, range(1, 100) r(t) GROUP BY head, t)) QUALIFY row_number() OVER (PARTITION BY head ORDER BY f1 DESC, t) = 1"""),
    "q_outcome_table": _chosen("sum_to_rank", final=_OUTCOME),
    "q_cutoff_worlds": """SELECT p_partkey, world, CASE level WHEN 'species' THEN 'genus' WHEN 'genus' THEN 'family' WHEN 'family' THEN 'order' ELSE 'species' END AS cutoff,
        CASE level WHEN 'species' THEN 5 WHEN 'genus' THEN 4 WHEN 'family' THEN 3 ELSE 6 END AS cutoff_index, level <> 'none' AS is_excluded, level FROM (
        SELECT p_partkey, ['CORE', 'S', 'G', 'F', 'other'][p_partkey % 5 + 1] AS world, CASE WHEN p_partkey % 5 = 1 AND p_partkey % 3 = 0 THEN 'species'
        WHEN p_partkey % 5 = 2 AND p_partkey % 2 = 0 THEN 'genus' WHEN p_partkey % 5 = 3 AND p_partkey % 7 <> 0 AND p_partkey % 4 = 0 THEN 'family' ELSE 'none' END AS level FROM part)""",
    "q_labels_by_name": "SELECT p_partkey, " + " || ',' || ".join("-1" if k is None else f"(p_partkey * {k} % 3 - 1)" for k in (7, None, 6, 4, None, 3, 2)) + " AS mixed, "
    + " || ',' || ".join(f"(p_partkey * {k} % 3 - 1)" for k in range(1, 8)) + " AS plain FROM part",
    "q_read_evaluation": _with("").rstrip() + _READS + "\nSELECT id, classified, path, taxid, true_taxid, outcome, call_rank, prob_species FROM told",
    "q_read_summary": _with("").rstrip() + _READS + f"""
SELECT *, {_RATES} FROM (SELECT path, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn FROM told GROUP BY path)""",
    "q_lineage_focal": "WITH cells AS (SELECT p_size, p_partkey, k, (p_partkey * (k + 3) % 41) / 8.0::DOUBLE - 2.5::DOUBLE AS x, p_partkey * (k + 1) % 3 - 1 AS t, p_partkey % (k + 2) <> 0 AS m FROM part, range(7) r(k)), "
    + ", ".join(f"""{name} AS (SELECT p_size, p_partkey, k, 1.0 / (1.0 + exp(-x)) AS q, {valid} AS v, CASE WHEN {valid} THEN
        {share} * pow(1.0 - CASE WHEN t > 0 THEN 1.0 / (1.0 + exp(-x)) ELSE 1.0 - 1.0 / (1.0 + exp(-x)) END, {gamma}) * (greatest(x, 0.0) - x * greatest(t, 0) + ln(1.0 + exp(-abs(x)))) * {weight} ELSE 0.0 END AS f FROM cells),
        {name}_f AS (SELECT p_size, sum(f) / greatest(count(*) FILTER (v), 1) AS loss FROM {name} GROUP BY p_size),
        {name}_h AS (SELECT p_size, {hier} * coalesce(sum(pow(greatest(c.q - a.q, 0.0), 2.0)), 0.0) / greatest(count(*), 1) AS pen FROM {name} a JOIN {name} c USING (p_size, p_partkey) WHERE c.k = a.k + 1 AND a.v AND c.v GROUP BY p_size)"""
        for name, valid, share, gamma, weight, hier in (("one", "t >= 0", "CASE WHEN t > 0 THEN 0.25 ELSE 0.75 END", "2.0", "1.0", "0.5"), ("two", "t >= 0 AND m", "1.0", "1.5", "[1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 4.0][k + 1]::DOUBLE", "0.25")))
    + " SELECT p_size, round(one_f.loss + coalesce(one_h.pen, 0.0), 9) AS plain, round(two_f.loss + coalesce(two_h.pen, 0.0), 9) AS full_loss FROM one_f JOIN two_f USING (p_size) LEFT JOIN one_h USING (p_size) LEFT JOIN two_h USING (p_size)",
    "q_focal": _with(f"""SELECT head, round(coalesce(sum({_BCE}) FILTER (pos % 7 <> 0), 0.0) / greatest(count(*) FILTER (pos % 7 <> 0), 1), 9) AS bce,
        round(coalesce(sum(pow(1.0 - exp(-{_BCE}), 2.0) * {_BCE}) FILTER (pos % 7 <> 0), 0.0) / greatest(count(*) FILTER (pos % 7 <> 0), 1), 9) AS focal FROM labelled GROUP BY head"""),
    "q_lineage_penalty": _with("""SELECT taxon, round(coalesce(sum(pow(greatest(p6 - p5, 0.0), 2)), 0.0) / greatest(count(*) FILTER (p5 IS NOT NULL AND p6 IS NOT NULL), 1), 9) AS penalty
        FROM (SELECT taxon, CASE WHEN p6 IS NOT NULL THEN p5 END AS p5, CASE WHEN p5 IS NOT NULL THEN p6 END AS p6 FROM scored) GROUP BY taxon"""),
    "q_weighted_loss": "SELECT l_returnflag, sum(trunc(l_discount * 100)::BIGINT * l_quantity::BIGINT)::DOUBLE / greatest(sum(l_quantity::BIGINT), 1)::DOUBLE AS mean FROM lineitem GROUP BY ALL",
    "q_isotonic": _with("").rstrip() + _ISO + """
SELECT head, round(x, 6) AS x, round(y, 9) AS y FROM (SELECT *, lag(round(y, 12)) OVER w AS before, lead(round(y, 12)) OVER w AS after FROM fitted WINDOW w AS (PARTITION BY head ORDER BY k))
WHERE before IS NULL OR after IS NULL OR round(y, 12) <> before OR round(y, 12) <> after""",
    "q_isotonic_apply": _with("").rstrip() + _ISO + "\nSELECT pos, round(f.y, 9) AS calibrated FROM labelled l JOIN fitted f ON f.head = l.head AND f.x = round(score, 6)",
    "q_head_scores": _with(" UNION ALL ".join(
        f"SELECT '{r}' AS head, count(*) AS n, count(p{k}) AS n_scored, CAST(sum(label{k}) AS BIGINT) AS positives FROM (SELECT DISTINCT id, taxon, p{k} FROM scored) JOIN (SELECT DISTINCT id, taxon, label{k} FROM pair_labels) USING (id, taxon)"
        for k, r in enumerate(RANKS))),
    "q_shard_offsets": _with("SELECT * FROM offs"),
    "q_locate": _with("SELECT p_partkey - 1 AS i, shard, p_partkey - 1 - first AS row FROM part JOIN offs ON p_partkey - 1 >= first AND p_partkey - 1 < first + n"),
    "q_epoch_sample": _with(f"SELECT shard, turn::INTEGER AS turn FROM (SELECT shard, row_number() OVER (ORDER BY {_SEED.format(670)}, shard) - 1 AS turn FROM shards) WHERE turn < 8"),
    "q_batches": """SELECT shard, row, k // 4 AS batch, (k % 4)::INTEGER AS place FROM (SELECT *, count(*) OVER (PARTITION BY shard, k // 4) AS c FROM (
        SELECT shard, row, row_number() OVER (PARTITION BY shard ORDER BY md5('668|' || shard || '|' || row), row) - 1 AS k FROM (SELECT (p_partkey % 20)::INTEGER AS shard, p_partkey // 20 AS row FROM part))
        WHERE k < 50) WHERE c = 4""",
    "q_batch_count": _with("SELECT CAST(sum(ceil(n / 64)) AS BIGINT) AS batches FROM shards"),
    "q_batch_estimate": _with("""SELECT setting::INTEGER AS setting, CAST(CASE setting WHEN 0 THEN 8 * ceil(m / 64) WHEN 1 THEN c * floor(200 / 64.0) WHEN 2 THEN 8 * ceil(200 / 64.0) ELSE c * floor(m / 64) END AS BIGINT) AS batches
        FROM (SELECT avg(n) AS m, count(*) AS c FROM shards), range(4) r(setting)"""),
    "q_dtypes": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
        f"CASE WHEN v = 0 THEN 0.0 ELSE round_even(v / pow(2.0, greatest(floor(log2(v)), {low}) - {bits - 1}), 0) * pow(2.0, greatest(floor(log2(v)), {low}) - {bits - 1}) END AS {name}" for name, bits, low in (("half", 11, -14), ("brain", 8, -126))
    ) + " FROM (SELECT *, (l_extendedprice::DOUBLE / (l_orderkey % 1000 + 1) / l_quantity::DOUBLE)::DOUBLE AS v FROM lineitem)",
    "q_split": f"SELECT p_partkey, CASE WHEN {_HASH.format("'667|' || p_partkey")} < {int(0.2 * (1 << 32))} THEN 'val' ELSE 'train' END AS split FROM part",
    "q_rank_stats": _with(f"SELECT CAST({_INDEX.format('canonical')} AS INTEGER) AS rank_index, count(*) AS n FROM cands LEFT JOIN named ON named.taxid = taxon GROUP BY ALL"),
    "q_rank_filter": _with("SELECT id, c.taxid, taxon FROM cands c JOIN named ON named.taxid = taxon WHERE canonical = 'species'"),
}

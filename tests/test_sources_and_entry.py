"""Readers, writers, streams, the command line and the entry module."""

import json
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom import cli, session
from taxaloom.functions.ranks import RANKS
from taxaloom.sources import intermediates, rank_index as ranked, readers, sinks
from taxaloom.streaming import reads as streams

ROOT = Path(__file__).resolve().parents[1]
READS = 'C\tr1\tName (taxid 60)\t100\t60:30 61:10 A:4 0:2\nU\tr2\tunclassified (taxid 0)\t90|90\t0:50\nC\tr10\tx (taxid 61)\t80\t\n'
DUMPS = {
    "nodes.dmp": "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n50\t|\t2\t|\tgenus\t|\n60\t|\t50\t|\tspecies\t|\n61\t|\t50\t|\tspecies\t|\n",
    "names.dmp": "60\t|\tFirst one\t|\t\t|\tscientific name\t|\n60\t|\tother\t|\t\t|\tsynonym\t|\n50\t|\tGenus\t|\t\t|\tscientific name\t|\n",
    "merged.dmp": "600\t|\t60\t|\n",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "reads.tsv").write_text(READS)
    (tmp_path / "dump").mkdir()
    for name, text in DUMPS.items():
        (tmp_path / "dump" / name).write_text(text)
    return tmp_path


def test_reads(spark, folder):
    got = {r["id"]: r for r in readers.classified_reads(spark, str(folder / "reads.tsv")).collect()}
    assert got["r1"]["length"] == 100 and got["r2"]["length"] is None and got["r10"]["kmers"] is None


def test_truth_files(spark, folder):
    (folder / "one").write_text("r1\tx|60|y\nr2\tz\n")
    assert {r["id"]: r["truth"] for r in readers.truth_one_file(spark, str(folder / "one")).collect()} == {"r1": "60", "r2": None}
    (folder / "map").write_text("r1\tGCF_1.12_x7/1\nr2\tother1/1\n")
    (folder / "genomes").write_text("tax_id\tfasta\n0\ta__b__60__GCF_1.1\n")
    assert {r["id"]: r["truth"] for r in readers.truth_two_files(spark, str(folder / "map"), str(folder / "genomes")).collect()} == {"r1": "60", "r2": None}


def test_taxonomy(spark, folder):
    with pytest.raises(readers.MissingTaxonomy):
        readers.taxonomy(spark, str(folder / "db"))
    sinks.store_taxonomy(*readers.taxonomy_dump(spark, str(folder / "dump")), str(folder / "db"))
    nodes, merged = readers.taxonomy(spark, str(folder / "db"))
    assert {r["taxid"]: r["name"] for r in nodes.collect()} == {1: None, 2: None, 50: "Genus", 60: "First one", 61: None} and merged.count() == 1


def test_shards_and_manifest(spark, folder):
    bad = spark.createDataFrame([("x", 1, [[0.0] * 21])], "id string, taxon long, bins array<array<float>>")
    rows = spark.createDataFrame([(f"r{k}", k, [[0.5] * 22]) for k in range(5)], bad.schema).coalesce(1)
    sinks.write_shards(rows.unionByName(bad).coalesce(1), str(folder / "shards"), shard_size=2)
    assert sorted(r["n"] for r in readers.shard_sizes(readers.shards(spark, str(folder / "shards"))).collect()) == [1, 2, 2]
    (folder / "manifest.json").write_text(json.dumps({"outputs": ["shards"]}))
    assert readers.shards(spark, str(folder / "manifest.json")).count() == 5
    (folder / "none.json").write_text(json.dumps({"outputs": []}))
    with pytest.raises(ValueError):
        readers.shards(spark, str(folder / "none.json"))
    assert sinks.compact(spark, str(folder / "shards"), str(folder / "one"), 1) == 5
    assert len(spark.read.parquet(str(folder / "one")).inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        sinks.compact(spark, str(folder / "nothing"), str(folder / "one"), 1)
    spark.createDataFrame([("a", "b")], "id string, taxon string").coalesce(1).write.mode("append").parquet(str(folder / "one"))
    with pytest.raises(TypeError):
        sinks.compact(spark, str(folder / "one"), str(folder / "two"), 1)
    assert sinks.compact(spark, str(folder / "shards"), str(folder / "three"), 1, cleanup=True) == 5
    assert not list((folder / "shards").glob("*.parquet"))


def test_shards_of_a_length_and_type(spark, folder):
    rows = spark.createDataFrame([("r", 1, [[k / 3] * 22 for k in range(4)])], "id string, taxon long, bins array<array<float>>")
    sinks.write_shards(rows, str(folder / "short"), dtype="bfloat16", target_length=7)
    got = readers.shards(spark, str(folder / "short")).first()
    assert got["length"] == 4 and len(got["bins"]) == 7 and [b[0] for b in got["bins"][::3]] == [0.0, 0.5, 1.0] and got["bins"][2][0] == 0.333984375


def test_stream_of_unique_reads(spark, folder):
    (folder / "in").mkdir()
    (folder / "in" / "a.tsv").write_text(READS)
    seen = []

    def run():
        query = streams.start(streams.unique(streams.stream(spark, str(folder / "in"))), lambda batch: batch, lambda df, n: seen.extend(r["id"] for r in df.collect()), str(folder / "state"))
        query.awaitTermination(120)
        return query

    run()
    assert sorted(seen) == ["r1", "r10", "r2"]
    (folder / "in" / "b.tsv").write_text("U\tr3\tx\t1\t\n")
    run()
    assert sorted(seen) == ["r1", "r10", "r2", "r3"]
    (folder / "in" / "c.tsv").write_text("U\tr2\tx\t1\t\n")  # of the first batch
    with pytest.raises(Exception, match="r2 occurs more than once"):
        run()


def test_stream(spark, folder):
    (folder / "in").mkdir()
    (folder / "in" / "a.tsv").write_text(READS)
    seen = []
    query = streams.start(streams.stream(spark, str(folder / "in")), streams.counts_plan, lambda df, n: seen.extend(map(tuple, df.collect())), str(folder / "state"))
    query.awaitTermination(120)
    assert sorted(seen) == [("r1", 0, 2), ("r1", 60, 30), ("r1", 61, 10), ("r2", 0, 50)]


def files_under(path):
    return sorted(str(p) for p in Path(path).rglob("*.parquet")) if Path(path).exists() else []


def test_a_second_run_reads_what_the_first_has_made(spark, folder, monkeypatch):
    db, out, cache = str(folder / "db"), str(folder / "out"), folder / "cache"
    assert cli.main(["setup", db, "--dump", str(folder / "dump")], spark) == 0
    base = ["extract", str(folder / "reads.tsv"), out, db, "--cache-dir", str(cache)]
    runs = []

    class Watched(intermediates.Intermediates):
        def __init__(self, *a, **k):
            super().__init__(*a, **k)
            runs.append(self)

    monkeypatch.setattr(cli, "Intermediates", Watched)
    (folder / "scratch").mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{folder}/scratch")
    assert cli.main(base, spark) == 0 and runs[-1].made == ["canonical", "reads", "pairs", "features"]
    assert (folder / "scratch").exists() and not files_under(folder / "scratch")  # scratch tables go with the command
    first, kept = readers.shards(spark, out).drop("shard").collect(), files_under(cache)
    assert cli.main(base, spark) == 0 and runs[-1].made == [] and files_under(cache) == kept
    assert readers.shards(spark, out).drop("shard").collect() == first
    (marker,) = cache.glob("pairs-*/_SUCCESS")
    marker.unlink()  # as if the run had died while it wrote them
    assert cli.main(base, spark) == 0 and runs[-1].made == ["pairs"]
    assert cli.main([*base, "--min-tax-kmers", "20"], spark) == 0 and len(runs[-1].made) == 4
    assert len(list(cache.glob("pairs-*"))) == 1  # of the run before, which nothing refers to now
    assert {r["taxon"] for r in readers.shards(spark, out).collect()} == {60}
    other = str(folder / "other")
    assert cli.main([*base[:2], other, *base[3:]], spark) == 0 and len(list(cache.glob("pairs-*"))) == 2
    (folder / "reads.tsv").write_text(READS.replace("61:10", "61:11"))
    assert cli.main(base, spark) == 0 and len(runs[-1].made) == 4 and len(list(cache.glob("pairs-*"))) == 2


def test_manifest_counts_and_sizes(spark, folder):
    db, out = str(folder / "db"), str(folder / "out")
    assert cli.main(["setup", db, "--dump", str(folder / "dump")], spark) == 0
    (folder / "reads.tsv").write_text(READS + "C\tlost\tx (taxid 77)\t80\t60:5\n")
    base = ["extract", str(folder / "reads.tsv"), out, db, "--shard-size", "1"]
    assert cli.main(base, spark) == 0
    spec = readers.manifest(spark, out + ".manifest")
    assert spec["counts"] == {"approx_rows": 2, "files": 2} and spec["sizes"] == [1, 1] and (spec["reads"], spec["dropped_reads"]) == (3, 1)
    assert sorted(r["n"] for r in readers.sizes(spark, out + ".manifest").collect()) == [1, 1]
    assert "ReadSchema: struct<>" in readers.shard_sizes(readers.shards(spark, out))._jdf.queryExecution().toString()
    for name, change in (("few", {"sizes": [1]}), ("wrong", {"sizes": [1, 2]})):
        (folder / f"{name}.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            readers.sizes(spark, str(folder / f"{name}.json"))
    (folder / "bare.json").write_text(json.dumps({"outputs": ["out"]}))
    assert readers.sizes(spark, str(folder / "bare.json")).count() == 2
    (folder / "reads.tsv").write_text(READS + READS)
    assert cli.main(base, spark) == 1  # ids that occur twice


def test_rank_index_opens_only_the_files_that_hold_a_rank(spark, folder):
    shards = str(folder / "shards")
    rows = [(f"r{k}", k, [[0.5] * 22], (k // 10) if k % 3 else None) for k in range(60)]
    spark.createDataFrame(rows, "id string, taxon long, bins array<array<float>>, rank_index int").repartitionByRange(6, "taxon").write.parquet(shards)
    index = ranked.index(spark, shards)
    want = {}
    for *_, r in rows:
        want[-1 if r is None else r] = want.get(-1 if r is None else r, 0) + 1
    assert {r["rank_index"]: r["n"] for r in ranked.stats(index).collect()} == want
    got = ranked.rows_of_rank(spark, shards, 4)
    assert {r["id"] for r in got.collect()} == {x[0] for x in rows if x[3] == 4} and len(got.inputFiles()) == 1
    places = {(r["shard"], r["row"]) for r in ranked.places(index, 4).collect()}
    own = spark.read.parquet(shards).select("_metadata.file_path", "_metadata.row_index", "rank_index").collect()
    assert places == {(r["file_path"], r["row_index"]) for r in own if r["rank_index"] == 4}
    assert ranked.rows_of_rank(spark, shards, 9).count() == 0
    before = files_under(shards + ".rank_index")
    ranked.index(spark, shards)
    assert files_under(shards + ".rank_index") == before
    spark.createDataFrame(rows[:1], "id string, taxon long, bins array<array<float>>, rank_index int").write.mode("append").parquet(shards)
    assert ranked.stats(ranked.index(spark, shards)).agg(F.sum("n")).first()[0] == 61
    spark.createDataFrame([x[:3] for x in rows], "id string, taxon long, bins array<array<float>>").write.parquet(str(folder / "bare"))
    assert ranked.rows_of_rank(spark, str(folder / "bare"), 4).count() == 60


def test_commands(spark, folder):
    db, out = str(folder / "db"), str(folder / "out")
    assert cli.main(["extract", str(folder / "reads.tsv"), out, db], spark) == 1  # no taxonomy yet
    assert cli.main(["setup", db, "--dump", str(folder / "dump")], spark) == 0
    assert cli.main(["extract", str(folder / "reads.tsv"), out, db], spark) == 0
    rows = readers.shards(spark, out)
    assert {(r["id"], r["taxon"]) for r in rows.select("id", "taxon").collect()} == {("r1", 60), ("r1", 61)}
    calls = str(folder / "calls")
    assert cli.main(["filter", out, str(folder / "reads.tsv"), calls, db, "--output-all"], spark) == 0
    got = {r["sequence_id"]: r for r in spark.read.option("sep", "\t").option("header", True).csv(calls).collect()}
    assert set(got) == {"r1", "r2", "r10"} and got["r1"]["chosen_rank"] in RANKS and got["r2"]["chosen_rank"] is None
    assert spark.read.option("sep", "\t").option("header", True).csv(calls + ".full").count() == 4
    parts = str(folder / "parts")
    assert cli.main(["split", out, parts, "--share", "0.5"], spark) == 0
    of = {p: {tuple(r) for r in readers.in_split(rows, parts, p).select("id", "taxon").collect()} for p in ("train", "val")}
    assert of["train"] | of["val"] == {("r1", 60), ("r1", 61)} and not of["train"] & of["val"]
    for part, held in of.items():
        assert cli.main(["filter", out, str(folder / "reads.tsv"), calls, db, "--split-dir", parts, "--split", part], spark) == (0 if held else 1)
    assert cli.main(["filter", str(folder / "nowhere"), str(folder / "reads.tsv"), calls, db], spark) == 1


def test_training_data_and_evaluation(spark, folder):
    db, out = str(folder / "db"), str(folder / "train")
    assert cli.main(["setup", db, "--dump", str(folder / "dump")], spark) == 0
    base = ["extract_train_data", str(folder / "reads.tsv"), out, db]
    (folder / "one").write_text("r1\tx|61|y\n")
    assert cli.main([*base, "--mess-truth-file", str(folder / "one")], spark) == 0
    rows = {r["taxon"]: r for r in readers.shards(spark, out).collect()}
    assert set(rows) == {60, 61} and {r["true_taxon"] for r in rows.values()} == {61} and {r["rank_index"] for r in rows.values()} == {RANKS.index("species")}
    assert rows[61]["labels"][RANKS.index("species")] == 1 and rows[60]["labels"][RANKS.index("species")] == 0 and rows[60]["labels"][RANKS.index("genus")] == 1
    (folder / "map").write_text("r1\tGCF_1.1x/1\nr2\tGCF_2.1x/1\nr10\tGCF_3.1x/1\n")
    (folder / "genomes").write_text("tax_id\tfasta\tpath\n61\ta__b__c__GCF_1.1\tincluded/x\n60\ta__b__c__GCF_2.1\tincluded/y\n61\ta__b__c__GCF_1.1x\tincluded/x\n60\ta__b__c__GCF_2.1x\tincluded/y\n")
    assert cli.main([*base, "--mess-truth-file", str(folder / "map"), "--mess-input-file", str(folder / "genomes"), "--min-tax-kmers", "20", "--topk-taxa", "1", "--format", "shards"], spark) == 0
    (only,) = readers.shards(spark, out).collect()
    assert (only["taxon"], only["true_taxon"], len(only["bins"])) == (60, 61, 1024)
    assert cli.main(base, spark) == 0 and readers.shards(spark, out).count() == 2
    told, table = str(folder / "metrics"), lambda p: spark.read.option("sep", "\t").option("header", True).csv(p).collect()
    assert cli.main(["evaluate", out, told, "--map-file", str(folder / "map")], spark) == 1
    truth = ["--kraken-input", str(folder / "reads.tsv"), "--map-file", str(folder / "map"), "--true-file", str(folder / "genomes"), "--db-dir", db]
    assert cli.main(["evaluate", out, told, "--network", "residual", *truth], spark) == 0
    assert {r["head"]: r["n"] for r in table(told)} == {r: "2" for r in RANKS} and len(spark.read.text(told + ".summary").collect()) == 7
    got = {r["id"]: r for r in table(told + ".reads")}
    assert set(got) == {"r1", "r2"} and got["r1"]["outcome"] == "FP" and got["r2"]["outcome"] == "FN" and got["r1"]["prob_species"] and not got["r2"]["prob_species"]
    assert [(r["tp"], r["fp"], r["fn"]) for r in table(told + ".rates")] == [("0", "1", "1")]
    bad = folder / "weights.npz"
    np.savez(bad, x=np.zeros(2))
    assert cli.main(["evaluate", out, told, "--model-path", str(bad)], spark) == 1


def test_ten_reads_make_136_rows(spark, folder):
    """Ten reads with so many taxa and bins each, from table to feature shards."""
    taxa, sizes = [2, 7, 49, 2, 4, 7, 2, 15, 39, 9], [10, 15, 9, 9, 10, 10, 9, 12, 16, 13]
    dump = [("nodes.dmp", "".join(f"{t}\t|\t50\t|\tspecies\t|\n" for t in range(1000, 1050))), ("names.dmp", ""), ("merged.dmp", "")]
    for name, text in dump:
        (folder / "dump" / name).write_text(DUMPS[name] + text)
    lines = []
    for k, (n, bins) in enumerate(zip(taxa, sizes, strict=True), 1):
        each = (1000 * (bins - 1) + 500) // n
        lines.append(f"C\tm{k}\tx (taxid 1000)\t{1000 * bins}\t" + " A:35 ".join(f"{1000 + j}:{each}" for j in range(n)) + f" 0:{1000 * (bins - 1) + 500 - each * n}\n")
    (folder / "ten.tsv").write_text("".join(lines))
    db, out = str(folder / "db"), str(folder / "shards")
    assert cli.main(["setup", db, "--dump", str(folder / "dump")], spark) == 0 and cli.main(["extract", str(folder / "ten.tsv"), out, db], spark) == 0
    rows = readers.shards(spark, out)
    assert rows.count() == 136 == sum(taxa)
    got = {r["id"]: (r["n"], r["bins"]) for r in rows.groupBy("id").agg(F.count("*").alias("n"), F.max(F.size("bins")).alias("bins")).collect()}
    assert got == {f"m{k}": (n, b) for k, (n, b) in enumerate(zip(taxa, sizes, strict=True), 1)}
    spec = readers.manifest(spark, out + ".manifest")
    assert spec["counts"]["approx_rows"] == 136 and spec["channels"] == 22


def test_queries_have_oracles():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    from taxaloom.plans.oracle import ORACLE
    from taxaloom.plans.queries import QUERIES

    assert set(ORACLE) == set(QUERIES) - {"q_network_scores", "q_training_step"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_bins", "q_select_best", "q_labels", "q_best_f1", "q_isotonic", "q_read_evaluation", "q_lineage_focal", "q_dtypes", "q_aupr"])
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from taxaloom.plans.oracle import ORACLE
    from taxaloom.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    engine = duckdb.connect()
    for table in Path(data).glob("*.parquet"):
        engine.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    got, want = QUERIES[name](spark, data).toPandas(), engine.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["q_select_best", "q_select_p_only", "q_select_strict", "q_select_deep", "q_select_lineage", "q_candidates"])
def test_candidates_need_no_lineages(spark, monkeypatch, name):
    from taxaloom.operators import taxonomy
    from taxaloom.plans.queries import QUERIES

    monkeypatch.setattr(taxonomy, "jumps", lambda nodes: pytest.fail("the tree is climbed"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_outcomes_climb_from_the_truths_only(spark, monkeypatch):
    from taxaloom.operators import taxonomy
    from taxaloom.plans.queries import QUERIES

    asked, climb = [], taxonomy.lineage
    monkeypatch.setattr(taxonomy, "lineage", lambda taxids, *rest: asked.append({r["taxid"] for r in taxids.collect()}) or climb(taxids, *rest))
    assert QUERIES["q_outcome_table"](spark, "/root/testdata/sf0.001").count()
    truths = QUERIES["q_true_taxon"](spark, "/root/testdata/sf0.001").collect()
    assert asked == [{r["true_taxon"] for r in truths}]


def test_outcomes_count_every_read(spark):
    """Unclassified reads have no call, and are the FN, TN and OTHER of the table."""
    from taxaloom.plans.queries import QUERIES

    got = {r["outcome"]: r["n"] for r in QUERIES["q_outcome_table"](spark, "/root/testdata/sf0.001").collect()}
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    left = orders.where("o_orderstatus = 'P'").groupBy(F.expr("o_orderkey % 3").alias("k")).count().collect()
    assert {k: got.get(k) for k in ("FN", "TN", "OTHER")} == {("FN", "TN", "OTHER")[r["k"]]: r["count"] for r in left}
    assert sum(got.values()) == orders.count()


def test_reads_of_an_evaluation_are_not_broadcast(spark):
    from taxaloom.operators import evaluation

    reads = spark.createDataFrame([("a", "C", "x (taxid 60)")], "id string, classified string, taxonomy string")
    mapped = spark.createDataFrame([("a", 60, "included/a")], "id string, true_taxid long, path string")
    scores = spark.createDataFrame([("a", 60, *[0.5] * 7)], "id string, taxon long, " + ", ".join(f"prob_{r} double" for r in RANKS))
    lines = spark.createDataFrame([(60, [1, 60])], "taxid long, path array<long>")
    nodes = spark.createDataFrame([(60, "species")], "taxid long, rank string")
    table = evaluation.read_table(reads, mapped, scores, lines, nodes)
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 2  # reads and scores, and the two small tables
    assert [(r["outcome"], r["rank"], r["prob_species"]) for r in table.collect()] == [("TP", "species", 0.5)]


def test_shuffles_of_a_stored_table_are_removed(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.toString() for b in _listed(blocks.getAllBlocks()) if b.isShuffle()}
    before = shuffles()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert session.stored(df, "few").count() == 10
    time.sleep(1)
    left = {b.split("_")[1] for b in shuffles() - before}
    assert spark.conf.get(session.CLEANUP) == "false" and len(left) == 1  # that of the count


def _listed(blocks):
    return [blocks.apply(k) for k in range(blocks.size())]


def test_a_read_is_dealt_without_its_tokens(spark):
    from taxaloom.plans import emulation

    plan = emulation.reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window ")
    assert plan.index(" AS token") < window and " AS token" not in plan[window:]


def test_entry_without_optional_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "taxaloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "taxaloom", tmp_path / "taxaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert 'q_bins' in e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

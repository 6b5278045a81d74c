"""Commands: setup, extract, extract_train_data, split, train, filter, evaluate, calibrate. Each returns 0, or 1 with a message where its input is missing."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tokens
from .functions.ranks import RANKS, canonical_rank, rank_index
from .operators import bins, calibration, candidates, evaluation, features, metrics, residual, sampling, scoring, selection, taxonomy, tensors, training
from .session import local_session, scratch, stored
from .sources import checkpoints, rank_index as ranked_rows, readers, sinks
from .sources.intermediates import Intermediates, sweep


class Stop(Exception):
    """Ends a command with exit code 1."""


def _setup(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.store_taxonomy(*readers.taxonomy_dump(spark, a.dump), a.db_dir, a.update)


#: Chooses candidates from the ranked taxa of reads (``candidates.ranked``) and their reported taxa (id, taxid).
Choice = Callable[[DataFrame, DataFrame], DataFrame]


def feature_table(
    reads: DataFrame, nodes: DataFrame, merged: DataFrame, least: int = 0, max_bins: int | None = None, truth: DataFrame | None = None, choose: Choice | None = None, own: Intermediates | None = None
) -> DataFrame:
    """Feature rows of classified reads: id, taxon, true_taxon, labels, bins, pos, rank_index (of the taxon, -1 if unknown).

    ``truth`` (id, truth) goes before what the read's name says; of several rows of a read the smallest counts. ``choose``
    selects from the ranked taxa in place of ``least``; without it all with that support are candidates. ``own`` keeps the
    tables on the way for a later run, and counts reads, ids that occur more than once, and reads whose taxon is unknown.
    """
    every = bins.runs(reads.where("kmers is not null and kmers <> ''"))
    called = reads.where("classified = 'C'")
    said = tokens.true_taxon_text(F.col("id"), F.col("taxonomy"))
    if truth is not None:
        called, said = called.join(truth.groupBy("id").agg(F.min("truth").alias("truth")), "id", "left"), F.coalesce("truth", said)
    true = taxonomy.normalize(called.select("id", tokens.taxid_of(said).alias("true_taxon")), "true_taxon", merged)

    def kept(name: str, make: Callable[[], DataFrame], **counts: Column) -> DataFrame:
        return own.table(name, make, **counts) if own else stored(make(), name)

    def ancestors() -> DataFrame:
        ids = every.where("taxid <> 0").select("taxid").union(true.select("true_taxon")).union(merged.join(every.select(F.col("taxid").alias("old")).distinct(), "old").select("new"))
        return taxonomy.canonical(taxonomy.lineage(ids.where("taxid is not null"), nodes, merged), nodes)

    canon = kept("canonical", ancestors)
    known = canon.select(F.col("taxid").alias("true_taxon"), F.lit(True).alias("known"))
    status = lambda: true.groupBy("id").agg(F.count("*").alias("copies"), F.min("true_taxon").alias("true_taxon")).join(taxonomy.sized(known), "true_taxon", "left")
    true = kept("reads", status, reads=F.sum("copies"), repeated=F.count_if(F.col("copies") > 1), dropped=F.count_if(F.col("known").isNull())).where("known").select("id", "true_taxon")
    runs = every.join(called.select("id"), "id", "left_semi")
    binned = bins.bins(bins.positions(runs))
    if max_bins:
        binned = bins.downsample(binned, max_bins)

    def candidate_pairs() -> DataFrame:
        ranked = candidates.ranked(runs, 0 if choose else least)
        if choose:
            ranked = choose(ranked, taxonomy.normalize(called.select("id", tokens.taxid_of(F.col("taxonomy")).alias("taxid")), "taxid", merged))
        return candidates.known_taxa(ranked, canon.select("taxid"), merged).join(true, "id")

    pairs = kept("pairs", candidate_pairs)

    def whole() -> DataFrame:
        rows = features.feature_rows(features.bin_features(binned, pairs.select("id", "taxid", "taxon"), canon, nodes))
        labels = candidates.labels(pairs, canon).select("id", "taxon", "true_taxon", F.array(*(F.col(f"label_{r}").cast("byte") for r in RANKS)).alias("labels"))
        ranks = nodes.select(F.col("taxid").alias("taxon"), rank_index(canonical_rank(F.col("rank"))).alias("rank_index"))
        out = rows.join(labels.dropDuplicates(["id", "taxon"]), ["id", "taxon"]).join(pairs.groupBy("id", "taxon").agg(F.min("pos").alias("pos")), ["id", "taxon"])
        return out.join(taxonomy.sized(ranks), "taxon", "left").fillna(-1, ["rank_index"])

    return kept("features", whole)


def _truth(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Truth of reads by one file (named once or twice) or by a map of reads with a table of genomes; None without a file."""
    if not a.mess_truth_file:
        return None
    if a.mess_input_file in (None, a.mess_truth_file):
        return readers.truth_one_file(spark, a.mess_truth_file)
    return readers.truth_two_files(spark, a.mess_truth_file, a.mess_input_file)


def _extract_train_data(spark: SparkSession, a: argparse.Namespace) -> None:
    def choose(ranked: DataFrame, reported: DataFrame) -> DataFrame:
        return candidates.training_candidates(ranked, reported, a.topk_taxa, a.neg_extra, a.seed, a.min_tax_kmers)

    if a.format == "parquet":
        a.target_length = 0
    _extract(spark, a, _truth(spark, a), choose, topk_taxa=a.topk_taxa, neg_extra=a.neg_extra, target_length=a.target_length)


def _extract(spark: SparkSession, a: argparse.Namespace, truth: DataFrame | None = None, choose: Choice | None = None, **settings: object) -> None:
    nodes, merged = readers.taxonomy(spark, a.db_dir)
    folder = a.cache_dir or a.output_path.rstrip("/") + ".intermediates"
    inputs = [p for p in (a.file_path, a.db_dir, getattr(a, "mess_truth_file", None), getattr(a, "mess_input_file", None)) if p]
    chosen = {k: v for k, v in settings.items() if k != "target_length"} | ({"seed": a.seed} if choose else {})
    own = Intermediates(spark, folder, inputs, min_tax_kmers=a.min_tax_kmers, max_bins=a.max_bins_per_seq, command=a.command, **chosen)
    rows = feature_table(readers.classified_reads(spark, a.file_path), nodes, merged, a.min_tax_kmers, a.max_bins_per_seq, truth, choose, own)
    own.note(a.output_path)
    sweep(spark, folder)
    if own.counts["repeated"]:
        raise Stop(f"{own.counts['repeated']} read ids occur more than once")
    n = sinks.write_shards(rows, a.output_path, a.shard_size, a.to_dtype, a.target_length)
    if not n:
        raise Stop("no read has evidence for a known taxon")
    counts = {"reads": own.counts["reads"] or 0, "dropped_reads": own.counts["dropped"]}
    sinks.write_manifest(spark, a.output_path.rstrip("/") + ".manifest", a.output_path, n, source=a.file_path, shard_size=a.shard_size, dtype=a.to_dtype, min_tax_kmers=a.min_tax_kmers, **counts, **settings)


#: Networks by name: seeded weights, and logits.
NETWORKS = {"cnn": (scoring.random_weights, scoring.forward), "residual": (residual.random_weights, residual.forward)}


def _scored(rows: DataFrame, a: argparse.Namespace, batch: int = 128, half: bool = True) -> DataFrame:
    """Scores of the network that is asked for; weights of a file must have the names and shapes of that network."""
    seeded, network = NETWORKS[a.network]
    weights = seeded(a.seed)
    if a.model_path:
        found = checkpoints.load_weights(rows.sparkSession, a.model_path)
        if {k: v.shape for k, v in found.items()} != {k: v.shape for k, v in weights.items()}:
            raise Stop(f"{a.model_path} doesn't hold the weights of the network {a.network}")
        weights = found
    return scoring.score(rows, weights, batch, half, network, a.pad_mode)


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    try:
        rows = readers.shards(spark, a.input_shards)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            raise Stop(f"no shards in {a.input_shards}") from error
        raise
    if a.split_dir:
        rows = readers.in_split(rows, a.split_dir, a.split)
    if rows.where(F.size("bins") > 0).isEmpty():
        raise Stop("the shards hold no rows with bins")
    nodes, _ = readers.taxonomy(spark, a.db_dir)
    scored = _scored(rows, a, a.batch_size, a.downcast == "fp16").join(rows.select("id", "taxon", "pos"), ["id", "taxon"])
    scored = stored(scored, "scored")
    reads = readers.classified_reads(spark, a.input_reads).withColumn("reported_taxid", tokens.reported_taxid(F.col("taxonomy")))
    base = ["classified", F.col("id").alias("sequence_id"), F.col("taxonomy").alias("reported_taxonomy"), "length", "reported_taxid"]
    if a.output_all:
        full = reads.join(scored, "id", "full_outer").select(*base, "taxon", *(f"prob_{r}" for r in RANKS))
        full.orderBy("sequence_id", "taxon").write.mode("overwrite").option("sep", "\t").option("header", True).csv(a.output_path + ".full")
    lineage = taxonomy.lineage(scored.select(F.col("taxon").alias("taxid")), nodes)
    calls = selection.back_off(selection.select_calls(scored, a.threshold, a.tie_break, on_fail=a.on_fail), taxonomy.output_ancestors(lineage, nodes))
    names = nodes.select(F.col("taxid").alias("final_taxid"), F.col("name").alias("refined_taxonomy"))
    out = reads.join(calls, "id", "full_outer").join(taxonomy.sized(names), "final_taxid", "left")
    sinks.write_calls(out.select(*base, F.col("final_taxid").alias("refined_taxid"), "refined_taxonomy", "chosen_rank", F.col("chosen_prob").alias("chosen_prob_at_rank"), *(f"prob_{r}" for r in RANKS)), a.output_path)


def _heads(rows: DataFrame, scored: DataFrame) -> DataFrame:
    labels = rows.select("id", "taxon", *(F.get("labels", F.lit(k)).cast("int").alias(f"label_{r}") for k, r in enumerate(RANKS)))
    return calibration.collect_heads(list(RANKS), scored.join(labels, ["id", "taxon"]))


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of every rank; with truth files also the table of reads (``.reads``) and its rates by truth (``.rates``)."""
    by_truth = (a.input_reads, a.map_file, a.true_file, a.db_dir)
    if any(by_truth) and not all(by_truth):
        raise Stop("read-level evaluation needs --kraken-input, --map-file, --true-file and --db-dir")
    rows = readers.shards(spark, a.input_shards)
    scored = stored(_scored(rows, a), "scored")
    heads = _heads(rows, scored)
    if a.calibration_dir:
        heads = calibration.apply(heads, spark.read.parquet(a.calibration_dir)).withColumn("score", F.col("calibrated")).drop("calibrated")
    heads = stored(heads.withColumn("pos", F.monotonically_increasing_id()), "heads")
    by = ["head"]
    out = heads.groupBy(*by).agg(F.count("*").alias("n")).join(metrics.rates(metrics.confusion(heads, by)), by)
    out = out.join(metrics.auroc(heads, by, "merged"), by).join(metrics.aupr(heads, by, "merged"), by).join(metrics.best_f1(heads, by).withColumnRenamed("f1", "best_f1"), by)
    out = stored(out, "metrics")
    ranks = spark.createDataFrame([(r,) for r in RANKS], "head string")
    sinks.write_metrics(ranks.join(out, "head", "left").fillna(0, ["n"]), a.output_path)
    sinks.write_summary(out, a.output_path + ".summary")
    if all(by_truth):
        nodes, merged = readers.taxonomy(spark, a.db_dir)
        mapped = stored(evaluation.mapped_reads(readers.simulated_names(spark, a.map_file), readers.genomes(spark, a.true_file)), "mapped")
        lines = taxonomy.paths(taxonomy.lineage(mapped.select(F.col("true_taxid").alias("taxid")).where("taxid is not null").distinct(), nodes, merged))
        table = stored(evaluation.read_table(readers.classified_reads(spark, a.input_reads), mapped, scored, lines, nodes), "read-table")
        table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(a.output_path + ".reads")
        sinks.write_metrics(metrics.rates(evaluation.summary(table)), a.output_path + ".rates")


def _sampled(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Rows of the drawn shards and so many of each, for validation: the same in every epoch."""
    if a.val_shards_per_epoch:
        shards = rows.select("shard").distinct()
        rows = rows.join(sampling.epoch_shards(shards, a.seed, 0, a.val_shards_per_epoch).select("shard"), "shard", "left_semi")
    if a.val_samples_per_shard:
        order = sampling.draw(str(a.seed), "shard", "id", "taxon")
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard").orderBy(order))).where(F.col("_k") <= a.val_samples_per_shard).drop("_k")
    return rows


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A model of all rows, and before it one of the rows of each rank that is asked for."""
    if bool(a.train) != bool(a.val) or not (a.train or a.input):
        raise Stop("give --train and --val, or --input for both")
    own = training.Settings(a.epochs, a.batch, a.parallel, a.lr, crop=a.crop_max, shards=a.shards_per_epoch, per_shard=a.samples_per_shard, seed=a.seed)
    for rank in [*(RANKS if a.ranks else ()), *([a.rank] if a.rank else ()), None]:
        paths = a.train or a.input, a.val or a.input
        rows, check = (ranked_rows.rows_of_rank(spark, p, RANKS.index(rank), a.rank_cache) if rank else readers.shards(spark, p) for p in paths)
        if a.split_dir:
            rows, check = readers.in_split(rows, a.split_dir, "train"), readers.in_split(check, a.split_dir, "val")
        try:
            notes = training.train(rows, _sampled(check, a), f"{a.save}_per-rank" + (f"_{rank}" if rank else ""), own)
        except ValueError as error:
            if rank and "known label" in str(error):
                print(f"no labelled row of rank {rank}", file=sys.stderr)
                continue
            raise Stop(str(error)) from error
        for epoch, loss, over in notes["losses"]:
            print(f"{rank or 'all'}: epoch {epoch}, loss {loss:.4f}, over validation rows {over:.4f}")


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_split(readers.shards(spark, a.input_shards), a.output_path, a.share, a.seed)


def _calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.shards(spark, a.input_shards)
    calibration.fit(_heads(rows, _scored(rows, a))).write.mode("overwrite").parquet(a.output_path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="taxaloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("setup", help="load a taxonomy dump into tables")
    p.add_argument("db_dir")
    p.add_argument("--dump", required=True, help="folder with nodes.dmp, names.dmp and merged.dmp")
    p.add_argument("--update", action="store_true")
    p.set_defaults(run=_setup)
    for name, run in (("extract", _extract), ("extract_train_data", _extract_train_data)):
        train = run is _extract_train_data
        p = sub.add_parser(name, help="classified reads to feature shards" + (" of chosen candidates, with labels by truth files" if train else ""))
        for argument in ("file_path", "output_path", "db_dir"):
            p.add_argument(argument)
        p.add_argument("--max-bins-per-seq", type=int)
        p.add_argument("--shard-size", type=int, default=4096)
        p.add_argument("--to-dtype", choices=("float32", "float16", "bfloat16", "fp32", "fp16", "bf16"), default="float32")
        p.add_argument("--target-length", type=int, default=1024 if train else 0)
        p.add_argument("--min-tax-kmers", type=int, default=10 if train else 0)
        p.add_argument("--cache-dir", help="tables that a later run with the same inputs reads; beside the output without it")
        p.set_defaults(run=run)
    p.add_argument("--format", choices=("parquet", "shards"), default="parquet", help="parquet keeps every bin, shards have --target-length bins")
    p.add_argument("--mess-truth-file")
    p.add_argument("--mess-input-file")
    p.add_argument("--topk-taxa", type=int, help="all without it")
    p.add_argument("--neg-extra", type=int, default=0)
    p = sub.add_parser("filter", help="feature shards to refined calls")
    for name in ("input_shards", "input_reads", "output_path", "db_dir"):
        p.add_argument(name)
    p.add_argument("--batch-size", type=int, default=128)
    p.add_argument("--downcast", choices=("fp16", "fp32"), default="fp16")
    p.add_argument("--output-all", action="store_true")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--tie-break", choices=selection.TIE_BREAKS, default="sum_to_rank")
    p.add_argument("--on-fail", choices=("deepest", "unclassified"), default="deepest")
    p.set_defaults(run=_filter)
    p = sub.add_parser("train", help="labelled shards to weights")
    for name, help_ in (("train", "shards to train on"), ("val", "shards to validate on"), ("input", "shards for both")):
        p.add_argument(f"--{name}", help=help_)
    for name, value in (("epochs", 20), ("batch", 64), ("parallel", 8), ("crop-max", tensors.CROP), ("shards-per-epoch", None), ("samples-per-shard", None), ("val-shards-per-epoch", None), ("val-samples-per-shard", None)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--lr", type=float, default=1e-3)
    p.add_argument("--save", default="model", help="folders of this name with the target, and the rank, behind it")
    p.add_argument("--target", choices=("per-rank",), default="per-rank", help="labels of every rank; losses of a single one need no such network")
    p.add_argument("--rank-cache", help="folder for the index of rows by rank; beside the shards without it")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--rank", choices=RANKS)
    which.add_argument("--ranks", action="store_true")
    p.set_defaults(run=_train)
    for q in (p, sub.choices["filter"]):
        q.add_argument("--split-dir", help="parts of the rows, as split writes them")
    sub.choices["filter"].add_argument("--split", choices=("train", "val"), default="val", help="the part to filter, with --split-dir")
    p = sub.add_parser("split", help="deal the rows of shards to train and val")
    p.add_argument("input_shards")
    p.add_argument("output_path")
    p.add_argument("--share", type=float, default=0.2)
    p.set_defaults(run=_split)
    for name, run in (("evaluate", _evaluate), ("calibrate", _calibrate)):
        q = sub.add_parser(name, help="metrics of labelled shards" if name == "evaluate" else "isotonic fits of labelled shards")
        q.add_argument("input_shards")
        q.add_argument("output_path")
        q.add_argument("--calibration-dir")
        q.set_defaults(run=run)
        if run is _evaluate:
            q.add_argument("--kraken-input", dest="input_reads", help="classified reads, for the read-level table")
            q.add_argument("--map-file", help="names of the reads in the simulation")
            q.add_argument("--true-file", help="genomes of the simulation: tax_id, fasta, path")
            q.add_argument("--db-dir")
    for q in sub.choices.values():
        q.add_argument("--model-path", help="npz file, or the folder best of a training run")
        q.add_argument("--network", choices=tuple(NETWORKS), default="cnn")
        q.add_argument("--seed", type=int, default=667)
        q.add_argument("--pad-mode", choices=scoring.PADS, default="true_length")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or local_session()
        with scratch(spark):
            args.run(spark, args)
    except (Stop, readers.MissingTaxonomy) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

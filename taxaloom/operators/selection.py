"""One call per read from the probabilities of its candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import RANKS
from ..functions.tokens import finite
from .taxonomy import sized

# Probabilities this close are ties.
RTOL, ATOL = 1e-12, 1e-15
TIE_BREAKS = ("p_only", "sum_to_rank", "deep_then_sum")


def _near(x: Column, most: Column) -> Column:
    return F.abs(x - most) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(most)


def _plus(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def select_calls(scored: DataFrame, threshold: float | dict[str, float] = 0.5, tie_break: str = "sum_to_rank", prefer_lineage: bool = False, on_fail: str = "deepest") -> DataFrame:
    """``scored`` (id, pos, taxon, prob_<rank>..., in_lineage) -> one row per id, with chosen_rank and chosen_prob.

    The chosen rank is the deepest at which any candidate reaches its threshold, whatever coarser ranks say; where none
    does, the deepest with a finite probability (``on_fail='deepest'``) or none (``'unclassified'``). Among candidates that
    tie at that rank, ``tie_break`` decides: ``p_only`` takes the first by ``pos``; ``sum_to_rank`` the largest sum of
    probabilities down to the rank; ``deep_then_sum`` adds the largest sum below it. A read without a finite probability
    keeps its first row with no rank. Non-finite probabilities are nulls. All windows share one exchange on id.
    """
    if tie_break not in TIE_BREAKS:
        raise ValueError(f"tie_break is one of {TIE_BREAKS}")
    if on_fail not in ("deepest", "unclassified"):
        raise ValueError("on_fail is deepest or unclassified")
    limits = {r: threshold.get(r, 0.5) if isinstance(threshold, dict) else threshold for r in RANKS}
    per = Window.partitionBy("id")
    rows = scored.select(*(finite(F.col(c)).alias(c) if c.startswith("prob_") else F.col(c) for c in scored.columns))
    probs = [F.col(f"prob_{r}") for r in RANKS]
    rows = rows.withColumn("_ok", _plus([p.isNotNull().cast("int") for p in probs]) > 0)
    if prefer_lineage:
        # a read with lineage rows is restricted to them before anything else
        rows = rows.withColumn("_in", F.coalesce("in_lineage", F.lit(False))).withColumn("_any", F.max("_in").over(per)).where(~F.col("_any") | F.col("_in")).drop("_in", "_any")
    rows = rows.withColumns({f"_m{k}": F.max(p).over(per) for k, p in enumerate(probs)})
    tops = [F.col(f"_m{k}") for k in range(7)]
    passed = F.coalesce(*(F.when(tops[k] >= limits[RANKS[k]], F.lit(k)) for k in range(6, -1, -1)))
    deepest = F.coalesce(*(F.when(tops[k].isNotNull(), F.lit(k)) for k in range(6, -1, -1)))
    rows = rows.withColumn("_r", F.coalesce(passed, deepest) if on_fail == "deepest" else passed)
    at = F.coalesce(*(F.when(F.col("_r") == k, p) for k, p in enumerate(probs)))
    best = F.coalesce(*(F.when(F.col("_r") == k, m) for k, m in enumerate(tops)))
    rows = rows.withColumns({"_p": at, "_tie": F.coalesce(_near(at, best), F.lit(False))})
    filled = [F.coalesce(p, F.lit(0.0)) for p in probs]
    keys: list[Column] = []
    if tie_break != "p_only":
        upto = F.coalesce(*(F.when(F.col("_r") == k, _plus(filled[: k + 1])) for k in range(7)))
        below = F.coalesce(*(F.when(F.col("_r") == k, _plus(filled[k + 1 :]) if k < 6 else F.lit(0.0)) for k in range(7)))
        for name, value in (("_s", upto), ("_d", below))[: 1 if tie_break == "sum_to_rank" else 2]:
            rows = rows.withColumn(name, F.when(F.col("_tie"), value))
            rows = rows.withColumn("_tie", F.coalesce(_near(F.col(name), F.max(name).over(per)), F.lit(False)))
    order = Window.partitionBy("id").orderBy(F.desc("_tie"), *keys, "pos")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    name = F.element_at(F.array(*map(F.lit, RANKS)), F.col("_r") + 1)
    kept = [c for c in scored.columns]
    return rows.select(*kept, F.when(F.col("_r").isNotNull(), name).alias("chosen_rank"), F.col("_p").alias("chosen_prob"))


def back_off(calls: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Adds ``final_taxid``: the call's deepest ancestor of exactly the chosen rank, else the call itself; null without a rank.

    ``ancestors`` is keyed by taxid with a column for each rank.
    """
    own = ancestors.select(F.col("taxid").alias("taxon"), *(F.col(r).alias(f"_a_{r}") for r in RANKS))
    out = calls.join(sized(own), "taxon", "left")
    anc = F.coalesce(*(F.when(F.col("chosen_rank") == r, F.col(f"_a_{r}")) for r in RANKS))
    return out.withColumn("final_taxid", F.when(F.col("chosen_rank").isNotNull(), F.coalesce(anc, "taxon"))).select(*calls.columns, "final_taxid")

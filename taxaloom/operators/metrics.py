"""Ranking and confusion metrics, loss expressions, and the outcome table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import RANKS
from ..session import observed, stored
from . import order
from .taxonomy import sized


def _curve(scored: DataFrame, by: list[str], ties: str) -> DataFrame:
    """Cumulative true and false positives by descending score, within groups of ``by``.

    ``ties='order'`` takes rows one at a time, ties in the order of ``pos``; ``'merged'`` takes equal scores as one step.
    Steps are written once and counted on the way. Where they are more than a range of ``order`` holds, they are dealt to
    ranges of score, so that windows run over a range and not over a group, and the sums of the ranges before are added, in
    integers. Where the ranges end changes no result.
    """
    y = F.col("y").cast("bigint")
    if ties == "merged":
        steps = scored.groupBy(*by, "score").agg(F.sum(y).alias("tp1"), F.count("*").alias("n1"), F.min("pos").alias("pos"))
    else:
        steps = scored.select(*by, "score", "pos", y.alias("tp1"), F.lit(1).cast("bigint").alias("n1"))
    steps, seen = observed(steps, "curve", n=F.count("*"))
    if seen["n"] <= order.PER:
        out = steps.withColumns({c: F.lit(0).cast("bigint") for c in ("tps", "ns", "ks")})
        totals, own = Window.partitionBy(*by), by
        out = out.withColumns({"p": F.sum("tp1").over(totals), "n": F.sum("n1").over(totals)})
    else:
        parts = order.dealt(steps, seen["n"], *map(F.col, by), F.desc("score"), F.col("pos"))
        sums = parts.groupBy(*by, "part").agg(F.sum("tp1").alias("tps"), F.sum("n1").alias("ns"), F.count("*").alias("ks"))  # a row a range and group
        totals = Window.partitionBy(*by)
        above = totals.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(*by, "part", F.sum("tps").over(totals).alias("p"), F.sum("ns").over(totals).alias("n"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("tps", "ns", "ks")))
        out, own = parts.join(sized(stored(base, "curve-ranges")), [*by, "part"]), [*by, "part"]
    down = Window.partitionBy(*own).orderBy(F.desc("score"), "pos")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"tp": F.sum("tp1").over(upto) + F.col("tps"), "seen": F.sum("n1").over(upto) + F.col("ns"), "k": (F.row_number().over(down) + F.col("ks")).cast("int")})
    out = out.withColumn("fp", F.col("seen") - F.col("tp"))
    return out.withColumns({"tp0": F.col("tp") - F.col("tp1"), "fp0": F.col("fp") - (F.col("n1") - F.col("tp1")), "seen0": F.col("seen") - F.col("n1")})


def auroc(scored: DataFrame, by: list[str], ties: str = "order") -> DataFrame:
    """``scored`` (by..., score, y, pos) -> by..., auroc: the area under the ROC steps; 0.5 where one class is missing.

    Areas are summed as integers and divided once.
    """
    twice = F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")))
    p, n = F.max("p"), F.max("n")
    area = F.when((p == 0) | (p == n), F.lit(0.5)).otherwise(twice / (F.lit(2) * p * (n - p)))
    return _curve(scored, by, ties).groupBy(*by).agg(area.cast("double").alias("auroc"))


def pr_curve(scored: DataFrame, by: list[str], ties: str = "order") -> DataFrame:
    """by..., k, recall, prec at every step; the anchor (0, 1) is step 0 and not listed."""
    return _curve(scored, by, ties).select(*by, "k", (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"), (F.col("tp") / F.greatest("seen", F.lit(1))).alias("prec"))


def aupr(scored: DataFrame, by: list[str], ties: str = "order") -> DataFrame:
    """by..., aupr: trapezoids of precision over recall from the anchor (0, 1)."""
    p = F.greatest("p", F.lit(1))
    last = F.when(F.col("seen0") == 0, F.lit(1.0)).otherwise(F.col("tp0") / F.col("seen0"))
    area = F.sum((F.col("tp1") / p) * (F.col("tp") / F.col("seen") + last) / 2)
    return _curve(scored, by, ties).groupBy(*by).agg(area.alias("aupr"))


def confusion(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """by..., tp, fp, fn, tn: a score strictly above the threshold is a positive."""
    hit, true = F.col("score") > threshold, F.col("y") == 1
    return scored.groupBy(*by).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, specificity, fpr, false_assignment (null without a denominator) and f1 (denominators of at least 1)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "false_assignment": F.try_divide(fp, tp + fp), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "fpr": F.try_divide(fp, tn + fp),
            "f1": F.lit(2) * tp / F.greatest(F.lit(2) * tp + fp + fn, F.lit(1)),
        }
    )


def best_f1(scored: DataFrame, by: list[str]) -> DataFrame:
    """by..., threshold, f1: the best of 0.01 to 0.99, the first of equals; 0.5 where every f1 is 0.

    Scores are first counted by the number of thresholds they lie above, so the thresholds meet at most 100 rows a group.
    """
    above = F.size(F.filter(F.sequence(F.lit(1), F.lit(99)), lambda t: F.col("score") > t / 100))
    cells = scored.groupBy(*by, above.alias("above")).agg(F.sum("y").alias("p1"), F.count("*").alias("n1"))
    whole = Window.partitionBy(*by)
    cells = cells.withColumn("p", F.sum("p1").over(whole)).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(99))))
    over = F.col("above") >= F.col("t")
    tp, seen = F.sum(F.when(over, F.col("p1")).otherwise(0)), F.sum(F.when(over, F.col("n1")).otherwise(0))
    f1 = F.lit(2) * tp / F.greatest(seen + F.max("p"), F.lit(1))
    each = cells.groupBy(*by, "t").agg(f1.alias("f1"))
    best = each.groupBy(*by).agg(F.max_by("t", F.struct("f1", -F.col("t"))).alias("t"), F.max("f1").alias("f1"))
    return best.select(*by, F.when(F.col("f1") > 0, F.col("t") / 100).otherwise(F.lit(0.5)).alias("threshold"), "f1")


def outcomes(calls: DataFrame) -> DataFrame:
    """``calls`` (classified, taxid, truth_path: array, path) with ``outcome``: TP, FP, FN, TN or OTHER."""
    called = F.col("classified") == "C"
    right = F.coalesce(F.array_contains("truth_path", F.col("taxid")), F.lit(False))
    out = F.when(called & right, "TP").when(called, "FP").when(F.col("path").startswith("included"), "FN").when(F.col("path").startswith("excluded"), "TN").otherwise("OTHER")
    return calls.withColumn("outcome", out)


def weighted_mean(table: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Mean of batch values by their weights, a sum of weights of 0 counted as 1."""
    return table.groupBy(*(by or [])).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias("mean"))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal(x: Column, y: Column, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    """Focal loss of a logit and a 0/1 label."""
    bce = bce_with_logits(x, y)
    return F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(gamma)) * bce


def masked_mean(loss: Column, valid: Column) -> Column:
    """Aggregate: mean over valid entries, none counted as one."""
    return F.sum(F.when(valid, loss).otherwise(0.0)) / F.greatest(F.count_if(valid), F.lit(1))


def lineage_penalty(parent: Column, child: Column, valid: Column) -> Column:
    """Aggregate: mean squared excess of a child rank's probability over its parent's, over valid pairs."""
    return masked_mean(F.pow(F.greatest(child - parent, F.lit(0.0)), F.lit(2.0)), valid)


def lineage_focal(logits: Column, targets: Column, gamma: float = 2.0, alpha: float | None = 0.25, lambda_hier: float = 0.5, rank_weights: list[float] | None = None, mask: Column | None = None) -> Column:
    """Aggregate over rows of seven logits and targets (arrays): focal loss of valid entries plus the lineage penalty.

    Targets below 0 and masked entries count for nothing; a child above its parent is penalised where both are valid. The
    seven entries are written out, as Spark compiles no function of array elements.
    """
    seven = range(len(RANKS))
    x, y = [F.get(logits, F.lit(k)) for k in seven], [F.get(targets, F.lit(k)) for k in seven]
    shown = [F.coalesce(y[k] >= 0, F.lit(False)) & (F.coalesce(F.get(mask, F.lit(k)) > 0, F.lit(False)) if mask is not None else F.lit(True)) for k in seven]
    prob = [F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) for v in x]

    def entry(k: int) -> Column:
        one = F.greatest(y[k], F.lit(0)).cast("double")
        right = F.when(one > 0.5, prob[k]).otherwise(F.lit(1.0) - prob[k])
        share = F.lit(1.0) if alpha is None else F.when(one > 0.5, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
        loss = share * F.pow(F.lit(1.0) - right, F.lit(gamma)) * bce_with_logits(x[k], one) * F.lit(rank_weights[k] if rank_weights else 1.0)
        return F.when(shown[k], F.coalesce(loss, F.lit(0.0))).otherwise(0.0)

    both = [shown[k] & shown[k + 1] for k in seven[:-1]]
    excess = [F.when(both[k], F.coalesce(F.pow(F.greatest(prob[k + 1] - prob[k], F.lit(0.0)), F.lit(2.0)), F.lit(0.0))).otherwise(0.0) for k in seven[:-1]]
    added = lambda parts: F.sum(reduce(lambda a, b: a + b, parts))
    counted = lambda flags: F.greatest(added([c.cast("int") for c in flags]), F.lit(1))
    return added([entry(k) for k in seven]) / counted(shown) + F.lit(lambda_hier) * added(excess) / counted(both)

"""Folds, scaling, class weights and curves: all as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed


def stratified_folds(labeled: DataFrame, n_folds: int = 5, seed: int = 42, key: tuple[str, ...] = ("src_id", "cand_id"), label: str = "label") -> DataFrame:
    """Adds `fold` 0 .. n_folds - 1: each label's rows, in the order of a seeded hash, go round the folds."""
    draw = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rows = labeled.withColumn("_draw", draw).withColumn("_part", F.left("_draw", F.lit(3)))
    # the order is cut by the hash's first digits, so that no window holds a whole class
    counts = rows.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_draw", *key))
    placed = rows.withColumn("_rank", rank).join(F.broadcast(firsts), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("fold", ((F.col("_first") + F.col("_rank") - 1) % n_folds).cast("int")).select(*labeled.columns, "fold")


def class_weights(labeled: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): rows over twice the class's rows."""
    counts = labeled.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("total") / (2 * F.col("n"))).alias("weight"))


def scaler(rows: DataFrame, features: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) of each feature, by one aggregate."""
    one = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (float(one[f"m_{f}"] or 0.0), float(one[f"s_{f}"] or 0.0) or 1.0) for f in features}


def scaled(rows: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m) / s for f, (m, s) in by.items()})


def _by(group: list[str]) -> list[Column]:
    return [F.col(g) for g in group]


#: Ranges of scores in which a curve is summed; a window holds one range of a group.
RANGES = 64


def pr_curve(scored: DataFrame, group: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(group, threshold, p, n, tp, fp, positives, rows, precision, recall) at `score >= threshold`, one row per distinct score; p and n count the score's own rows.

    Scores are cut into ranges; sums within a range are added to those of the
    ranges above, so that no task ranks all scores. The rows are read once: what
    is written are the sums by score.
    """
    g = list(group)
    points = scored.groupBy(*g, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    points = checkpointed(points)
    cuts = points.agg(F.percentile_approx(F.col("threshold").cast("double"), [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]), lambda x: x > F.col("threshold"))) if cuts else F.lit(0)
    points = points.withColumn("_range", above)
    sums = points.groupBy(*g, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before, whole = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*g)
    sums = sums.select(
        *[F.col(c).alias(f"_g_{c}") for c in g], F.col("_range").alias("_at"),
        F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seen"),
        F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("rows"),
    )
    same = F.col("_range") == F.col("_at")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    down = Window.partitionBy(*g, "_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumns({"_in_tp": F.sum("p").over(down), "_in_seen": F.sum("n").over(down)}).join(F.broadcast(sums) if not g else sums, same)
    out = out.withColumns({"tp": F.col("_in_tp") + F.col("_tp"), "seen": F.col("_in_seen") + F.col("_seen")})
    return out.select(
        *g, "threshold", "p", "n", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "positives", "rows",
        (F.col("tp") / F.col("seen")).alias("precision"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"),
    )


def average_precision(curve: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, average_precision): precision summed over the steps of recall, which are the scores' own positives; 0 without positives."""
    step = F.when(F.col("positives") > 0, F.col("p") / F.col("positives")).otherwise(0.0)
    return curve.groupBy(*group).agg(F.sum(step * F.col("precision")).alias("average_precision"))


def roc_auc(curve: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, roc_auc): trapezoids between distinct scores, which is the rank sum with ties at their mean; null with one class."""
    area = (F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2
    cells = F.max(F.col("positives") * (F.col("rows") - F.col("positives")))
    return curve.groupBy(*group).agg((F.sum(area) / F.nullif(cells, F.lit(0))).alias("roc_auc"))


def f1_points(curve: DataFrame, group: tuple[str, ...] = (), align: str = "correct") -> DataFrame:
    """The curve with f1. align="shifted" gives each threshold the F1 of the next higher one, as some published code does."""
    if align not in ("correct", "shifted"):
        raise ValueError(f"unknown alignment {align!r}")
    tp, seen = F.col("tp"), F.col("tp") + F.col("fp")
    if align == "shifted":
        # at the next higher threshold the score's own rows are missing
        tp, seen = tp - F.col("p"), seen - F.col("n")
    precision, recall = tp / F.nullif(seen, F.lit(0)), tp / F.nullif(F.col("positives"), F.lit(0))
    f1 = F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return curve.withColumn("f1", f1)


def best_threshold(scored: DataFrame, group: tuple[str, ...] = (), align: str = "correct", label: str = "label", score: str = "score") -> DataFrame:
    """(group, threshold, f1, precision, recall): the least threshold of greatest F1."""
    points = f1_points(pr_curve(scored, group, label, score), group, align).withColumn("f1", F.round("f1", 9))
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold")))
    out = points.groupBy(*group).agg(best.alias("_b"))
    return out.filter("_b is not null").select(*group, "_b.threshold", "_b.f1", "_b.precision", "_b.recall")


def fold_report(scored: DataFrame, group: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(fold, n, positive_rate, roc_auc, pr_auc, threshold, f1, precision, recall)."""
    g = list(group)
    sizes = scored.groupBy(*g).agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate"))
    curve = pr_curve(scored, group)
    parts = (roc_auc(curve, group), average_precision(curve, group).withColumnRenamed("average_precision", "pr_auc"), best_threshold(scored, group))
    for part in parts:
        sizes = sizes.join(part, g) if g else sizes.join(F.broadcast(part))
    return sizes

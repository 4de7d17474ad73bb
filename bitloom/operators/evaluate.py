"""Evaluation of each (algo, transform, metric) triplet as a binary classifier.

Everything is grouped by triplet in one plan. Rows collapse first to one per triplet and
distinct score, of which there are few (a 64-bit Hamming distance has 65 values), so the
windows of the curve never see more than the distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from bitloom.operators.transforms import ORIG

TRIPLET = ("algo", "transform", "metric")
#: Decimals of a score: equal scores that differ in the last place are one threshold.
DECIMALS = 12


def scores(distances: DataFrame) -> DataFrame:
    """For each triplet and class-1 transform: its intra rows, and the inter rows of the same transform; null scores are left out."""
    return distances.where((F.col("transform") != ORIG) & F.col("similarity").isNotNull()).select(*TRIPLET, "class", F.bround("similarity", DECIMALS).alias("s"))


def histogram(distances: DataFrame, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, s, p, n): positives and negatives at each distinct score."""
    c = F.col("class")
    return scores(distances).groupBy(*keys, "s").agg(F.sum(F.when(c == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(c == 0, 1).otherwise(0)).alias("n"))


def roc_points(hist: DataFrame, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, threshold, fpr, tpr, tp, fp, p_all, n_all): points by descending threshold, from (0, 0, +inf) on.

    Interior points on a straight line are dropped. A triplet without both classes has no curve.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("s"))
    every = Window.partitionBy(*keys)
    h = hist.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("p_all", F.sum("p").over(every)).withColumn("n_all", F.sum("n").over(every))
    bend = lambda c: F.lead(c).over(down) - 2 * F.col(c) + F.lag(c).over(down)
    h = h.withColumn("first", F.lag("s").over(down).isNull()).withColumn("bt", bend("tp")).withColumn("bf", bend("fp")).where("p_all > 0 and n_all > 0").where("bt is null or bf is null or bt <> 0 or bf <> 0")
    point = lambda s, tp, fp: F.struct(s.cast("double").alias("threshold"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"))
    own, start = point(F.col("s"), F.col("tp"), F.col("fp")), point(F.lit(float("inf")), F.lit(0), F.lit(0))
    h = h.select(*keys, "p_all", "n_all", F.explode(F.when(F.col("first"), F.array(start, own)).otherwise(F.array(own))).alias("x"))
    h = h.select(*keys, "p_all", "n_all", "x.threshold", "x.tp", "x.fp")
    return h.select(*keys, "threshold", (F.col("fp") / F.col("n_all")).alias("fpr"), (F.col("tp") / F.col("p_all")).alias("tpr"), "tp", "fp", "p_all", "n_all")


def _segments(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    out = points
    for c in ("fpr", "tpr", "threshold"):
        out = out.withColumn(f"{c}0", F.lag(c).over(down))
    # The lowest threshold of all points with this FPR: the lower end of a vertical step.
    return out.withColumn("low", F.min("threshold").over(Window.partitionBy(*keys, "fpr"))).where("fpr0 is not null")


def auc(points: DataFrame, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, auc) by the trapezoid rule."""
    area = (F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2
    return _segments(points, keys).groupBy(*keys).agg(F.sum(area).alias("auc"))


def eer(points: DataFrame, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, eer, eer_threshold): where FPR = 1 - TPR, linear between points.

    The threshold is interpolated on FPR. On the first segment, whose upper threshold is
    infinite, it is the lower one; at a vertical step it is the step's lowest.
    """
    s = _segments(points, keys).withColumn("g0", 1 - F.col("fpr0") - F.col("tpr0")).withColumn("g1", 1 - F.col("fpr") - F.col("tpr")).where("g0 > 0 and g1 <= 0")
    t = F.col("g0") / (F.col("g0") - F.col("g1"))
    x = F.col("fpr0") + (F.col("fpr") - F.col("fpr0")) * t
    inner = F.col("threshold0") + (F.col("threshold") - F.col("threshold0")) * t
    threshold = F.when((F.col("g1") == 0) | (F.col("fpr") == F.col("fpr0")), F.col("low")).when(F.col("threshold0") == float("inf"), F.col("threshold")).otherwise(inner)
    return s.select(*keys, x.alias("eer"), threshold.alias("eer_threshold"))


def fpr_threshold(points: DataFrame, max_fpr: float, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, threshold) at a false-positive rate, linear on FPR; finite on the first segment too."""
    s = _segments(points, keys).where((F.col("fpr") > F.col("fpr0")) & (F.col("fpr0") <= max_fpr) & (F.col("fpr") >= max_fpr))
    t = (F.lit(max_fpr) - F.col("fpr0")) / (F.col("fpr") - F.col("fpr0"))
    value = F.when(F.col("threshold0") == float("inf"), F.col("threshold")).otherwise(F.col("threshold0") + (F.col("threshold") - F.col("threshold0")) * t)
    s = s.withColumn("t", value)
    return s.groupBy(*keys).agg(F.max_by("t", -F.col("fpr")).alias("threshold"))


def predict(similarity: Column, threshold: Column, pos_label: int = 1) -> Column:
    """1 where a score is predicted positive."""
    if pos_label not in (0, 1):
        raise ValueError("pos_label must be 0 or 1")
    return (similarity >= threshold if pos_label == 1 else similarity <= threshold).cast("int")


def confusion(hist: DataFrame, thresholds: DataFrame, normalize: str | None = "true", weighted: bool = False, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, tn, fp, fn, tp) at each triplet's threshold (keys, threshold).

    normalize "true" gives rates within each class, None or "none" counts; weighted counts
    are those with balanced class weights n / (2 n_class), which rates do not depend on.
    """
    h = hist.join(thresholds.select(*keys, "threshold"), list(keys))
    hit = F.col("s") >= F.col("threshold")
    total = lambda c, keep: F.sum(F.when(keep, F.col(c)).otherwise(0)).cast("double")
    h = h.groupBy(*keys).agg(total("n", ~hit).alias("tn"), total("n", hit).alias("fp"), total("p", ~hit).alias("fn"), total("p", hit).alias("tp"))
    n0, n1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    if normalize == "true":
        w0, w1 = 1 / n0, 1 / n1
    elif weighted:
        w0, w1 = (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)
    else:
        w0 = w1 = F.lit(1.0)
    return h.select(*keys, (F.col("tn") * w0).alias("tn"), (F.col("fp") * w0).alias("fp"), (F.col("fn") * w1).alias("fn"), (F.col("tp") * w1).alias("tp"))


def metrics(hist: DataFrame, preset: DataFrame | None = None, normalize: str | None = "true", weighted: bool = True, keys: Sequence[str] = TRIPLET) -> DataFrame:
    """(keys, auc, eer, eer_threshold, tn, fp, fn, tp, decision_threshold) for every triplet.

    preset (algo, metric, threshold) replaces the EER threshold where it has the triplet.
    """
    points = roc_points(hist, keys)
    m = auc(points, keys).join(eer(points, keys), list(keys), "left")
    if preset is not None:
        m = m.join(F.broadcast(preset.select("algo", "metric", F.col("threshold").alias("preset"))), ["algo", "metric"], "left")
        m = m.withColumn("decision_threshold", F.coalesce("preset", "eer_threshold")).drop("preset")
    else:
        m = m.withColumn("decision_threshold", F.col("eer_threshold"))
    cm = confusion(hist, m.select(*keys, F.col("decision_threshold").alias("threshold")), normalize, weighted, keys)
    return m.join(cm, list(keys), "left").select(*keys, "auc", "eer", "eer_threshold", "tn", "fp", "fn", "tp", "decision_threshold")


def reference_form(m: DataFrame) -> DataFrame:
    """The evaluation table with the column names of reports."""
    names = {"algo": "Algorithm", "transform": "Transform", "metric": "Metric", "auc": "AUC", "eer": "EER", "eer_threshold": "EER-Threshold", "tn": "TN", "fp": "FP", "fn": "FN", "tp": "TP", "decision_threshold": "Decision_Threshold"}
    return m.select(*(F.col(c).alias(n) for c, n in names.items()))

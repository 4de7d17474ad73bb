"""Summaries of similarities and of evaluation tables, and data for plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from bitloom.operators.transforms import ORIG


def describe(distances: DataFrame, keys: Sequence[str] = ("algo", "metric"), column: str = "similarity") -> DataFrame:
    """count, mean, std, min, quartiles (linear) and max of each group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = distances.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return g.select(*keys, "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), "max")


def inter_summary(distances: DataFrame) -> DataFrame:
    """Mean, median and population deviation of the originals' inter scores, to four decimals."""
    d = distances.where((F.col("class") == 0) & (F.col("transform") == ORIG))
    return d.groupBy("algo", "metric").agg(F.bround(F.avg("similarity"), 4).alias("mean"), F.bround(F.median("similarity"), 4).alias("median"), F.bround(F.stddev_pop("similarity"), 4).alias("std"))


def by_group(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    return m.groupBy(*keys).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg("eer").alias("eer_mean"), F.stddev_samp("eer").alias("eer_std"))


def by_grouping_sets(m: DataFrame) -> DataFrame:
    """Means by algorithm; by algorithm and metric; by all three, in one pass."""
    return m.rollup("algo", "metric", "transform").agg(F.avg("auc").alias("auc_mean"), F.avg("eer").alias("eer_mean")).where("algo is not null")


def overall(m: DataFrame) -> DataFrame:
    return m.agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg("eer").alias("eer_mean"), F.stddev_samp("eer").alias("eer_std"))


def auc_pivot(m: DataFrame, transforms: Sequence[str]) -> DataFrame:
    return m.groupBy("metric", "algo").pivot("transform", list(transforms)).agg(F.avg("auc"))


def versus_baseline(m: DataFrame, baseline: str) -> DataFrame:
    """Change of AUC in percentage points against one metric, to three decimals, without its own rows."""
    base = m.where(F.col("metric") == baseline).select("algo", "transform", F.col("auc").alias("base"))
    return m.where(F.col("metric") != baseline).join(base, ["algo", "transform"]).select("algo", "transform", "metric", F.bround((F.col("auc") - F.col("base")) * 100, 3).alias("change"))


def improvement(plain: DataFrame, weighted: DataFrame) -> DataFrame:
    """AUC with and without weights, and the difference."""
    keys = ["algo", "transform", "metric"]
    return plain.select(*keys, F.col("auc").alias("auc_plain")).join(weighted.select(*keys, F.col("auc").alias("auc_weighted")), keys).withColumn("improvement", F.col("auc_weighted") - F.col("auc_plain"))


def histogram_bins(distances: DataFrame, bins: int = 25) -> DataFrame:
    """(algo, metric, class, bin, n, share) over [0, 1]; 1 falls in the last bin."""
    b = F.least(F.greatest(F.floor(F.bround("similarity", 12) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    g = distances.where("similarity is not null").groupBy("algo", "metric", "class", b.alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("algo", "metric", "class")))


def density(distances: DataFrame, points: int = 101) -> DataFrame:
    """(algo, metric, class, x, density): Gaussian kernel with Scott's bandwidth on a grid of [0, 1].

    The kernel runs over distinct scores with their counts, so a group costs points times
    its distinct scores. A group of one score, or of no spread, has no density.
    """
    keys = ["algo", "metric", "class"]
    h = distances.where("similarity is not null").groupBy(*keys, F.bround("similarity", 12).alias("s")).agg(F.count("*").alias("c"))
    g = h.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("s")).alias("t"), F.sum(F.col("c") * F.col("s") * F.col("s")).alias("q"))
    var = (F.col("q") - F.col("t") * F.col("t") / F.col("n")) / (F.col("n") - 1)
    g = g.where("n > 1").withColumn("bw", F.sqrt(F.greatest(var, F.lit(0.0))) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("bw > 1e-12").select(*keys, "n", "bw")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(float(points - 1)))).alias("x")
    rows = h.join(g, keys).select(*keys, "s", "c", "n", "bw", grid)
    z = (F.col("x") - F.col("s")) / F.col("bw")
    part = F.col("c") * F.exp(-z * z / 2) / (F.col("n") * F.col("bw") * F.lit(2.5066282746310002))
    return rows.groupBy(*keys, "x").agg(F.sum(part).alias("density"))


def letter_values(samples: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median, fourths, eighths and sixteenths of each group, for letter-value plots."""
    ps = [1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16]
    g = samples.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, ps))).alias("q"))
    return g.select(*keys, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("lo16", "lo8", "lo4", "median", "hi4", "hi8", "hi16"))))


def error_curves(points: DataFrame) -> DataFrame:
    """FPR and FNR by threshold, finite thresholds only."""
    return points.where(F.col("threshold") != float("inf")).select("algo", "transform", "metric", "threshold", "fpr", (1 - F.col("tpr")).alias("fnr"))

"""How often each bit of a hash survives, and the bit weights that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bitloom.operators.evaluate import DECIMALS, TRIPLET
from bitloom.operators.transforms import ORIG

QUADRANTS = ("TP", "FN", "FP", "TN")


def bit_frequencies(distances: DataFrame, hashes: DataFrame, thresholds: DataFrame, n_bits: int = 64) -> DataFrame:
    """(algo, transform, metric, quadrant, bit, freq) with all quadrants and bits of each triplet.

    Class 1: share of pairs whose original and variant agree in the bit. Class 0: share of
    pairs whose two variants differ in it. A quadrant without pairs has 0 (TP, TN) or 1 (FN,
    FP). thresholds is (algo, transform, metric, threshold).

    The hashes travel packed: agreeing bits are one word, and each bit is summed by its own
    aggregate, so nothing is exploded before the groups are formed.
    """
    d = distances.where((F.col("transform") != ORIG) & F.col("similarity").isNotNull()).join(thresholds.select(*TRIPLET, "threshold"), list(TRIPLET))
    hit = F.bround("similarity", DECIMALS) >= F.col("threshold")
    d = d.select(*TRIPLET, "class", "file_a", "file_b", F.when(F.col("class") == 1, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN")).alias("quadrant"))
    d = d.withColumn("t_a", F.when(F.col("class") == 1, F.lit(ORIG)).otherwise(F.col("transform")))
    h = hashes.select("file_id", "algo", "transform", "packed")
    left = h.select(F.col("file_id").alias("file_a"), "algo", F.col("transform").alias("t_a"), F.col("packed").alias("pa"))
    right = h.select(F.col("file_id").alias("file_b"), "algo", "transform", F.col("packed").alias("pb"))
    d = d.join(left, ["file_a", "algo", "t_a"]).join(right, ["file_b", "algo", "transform"])
    words = -(-n_bits // 64)
    for w in range(words):
        x = F.get("pa", F.lit(w)).bitwiseXOR(F.get("pb", F.lit(w)))
        d = d.withColumn(f"w{w}", F.when(F.col("class") == 1, F.bitwise_not(x)).otherwise(x))
    sums = [F.sum(F.shiftrightunsigned(f"w{i // 64}", i % 64).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(n_bits)]
    g = d.groupBy(*TRIPLET, "quadrant").agg(F.count("*").alias("n"), *sums)
    g = g.select(*TRIPLET, "quadrant", F.array(*(F.col(f"b{i}") / F.col("n") for i in range(n_bits))).alias("f"))
    grid = thresholds.select(*TRIPLET).crossJoin(F.broadcast(thresholds.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "quadrant string")))
    empty = F.when(F.col("quadrant").isin("TP", "TN"), 0.0).otherwise(1.0)
    full = grid.join(g, [*TRIPLET, "quadrant"], "left").withColumn("f", F.coalesce("f", F.array_repeat(empty, n_bits)))
    return full.select(*TRIPLET, "quadrant", F.posexplode("f").alias("bit", "freq"))


def bit_weights(freq: DataFrame, statistic: str = "median") -> DataFrame:
    """(algo, metric, bit, weight): over the quadrants of each bit first, then over the transforms but the original."""
    agg = F.median if statistic == "median" else F.avg
    per = freq.where(F.col("transform") != ORIG).groupBy(*TRIPLET, "bit").agg(agg("freq").alias("w"))
    return per.groupBy("algo", "metric", "bit").agg(agg("w").alias("weight"))


def weight_vectors(weights: DataFrame) -> dict[tuple[str, str], Sequence[float]]:
    """{(algo, metric): weights by bit} for a second, weighted pass: a few hundred numbers for each pair."""
    rows = weights.groupBy("algo", "metric").agg(F.sort_array(F.collect_list(F.struct("bit", "weight"))).alias("w")).collect()
    return {(r.algo, r.metric): [x.weight for x in r.w] for r in rows}

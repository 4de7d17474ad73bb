"""Pairs of hashes and their similarities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bitloom.functions.metrics import Metric
from bitloom.operators.transforms import ORIG


def inter_sample_size(n: int) -> int:
    """Smallest m < n with m (m - 1) / 2 > n, or 0."""
    m = (1 + math.isqrt(1 + 8 * n)) // 2 + 1
    while m > 1 and (m - 1) * (m - 2) // 2 > n:
        m -= 1
    return m if 0 < m < n else 0


def sample_files(hashes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n files (file_id) by the order of md5(seed:file_id); an error if there are fewer.

    The order depends on seed and id alone, so a sample is the same on any partitioning.
    """
    files = hashes.select("file_id").distinct()
    picked = files.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("file_id").cast("string"))), "file_id").limit(n)
    return picked


def _similarities(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], n_bits: int, weights: dict[tuple[str, str], Sequence[float]] | None, fixed: Column | None = None) -> DataFrame:
    """One row for each pair and metric; all metrics are columns of one select first, so they share counts."""
    u, v = ([F.get(c, F.lit(i)) for i in range(-(-n_bits // 64))] for c in ("pu", "pv"))
    out = []
    for m in metrics:
        plain = 1.0 - m.distance(u, v, n_bits)
        value = plain
        if weights:
            cases = None
            for (algo, metric), w in sorted(weights.items()):
                if metric == m.name:
                    d = 1.0 - m.distance(u, v, n_bits, w)
                    cases = F.when(F.col("algo") == algo, d) if cases is None else cases.when(F.col("algo") == algo, d)
            value = cases.otherwise(plain) if cases is not None else plain
        out.append(F.struct(F.lit(m.name).alias("metric"), value.alias("similarity")))
    return pairs.select(*keys, F.explode(F.array(*out)).alias("m")).select(*keys, "m.metric", "m.similarity")


KEYS = ("file_a", "file_b", "algo", "class", "transform")


def intra_similarities(hashes: DataFrame, metrics: Sequence[Metric], n_bits: int = 64, weights: dict | None = None) -> DataFrame:
    """Each original against its variants (class 1), itself included: (file_a, file_b, algo, class, transform, metric, similarity)."""
    orig = hashes.where(F.col("transform") == ORIG).select("file_id", "algo", F.col("packed").alias("pu"))
    other = hashes.select("file_id", "algo", "transform", F.col("packed").alias("pv"))
    pairs = orig.join(other, ["file_id", "algo"]).select(F.col("file_id").alias("file_a"), F.col("file_id").alias("file_b"), "algo", F.lit(1).alias("class"), "transform", "pu", "pv")
    return _similarities(pairs, KEYS, metrics, n_bits, weights)


def inter_similarities(hashes: DataFrame, sample: DataFrame, metrics: Sequence[Metric], n_bits: int = 64, weights: dict | None = None) -> DataFrame:
    """All pairs of sampled files within each transform (class 0), file_a < file_b.

    The sample has about sqrt(2 N) files, so its pairs are as many as the N files. It is
    joined by an equality on (algo, transform), and broadcast by Spark where its size allows.
    """
    few = hashes.join(sample.select("file_id"), "file_id", "left_semi")
    a = few.select(F.col("file_id").alias("file_a"), "algo", "transform", F.col("packed").alias("pu"))
    b = few.select(F.col("file_id").alias("file_b"), "algo", "transform", F.col("packed").alias("pv"))
    pairs = a.join(b, ["algo", "transform"]).where("file_a < file_b").withColumn("class", F.lit(0))
    return _similarities(pairs, KEYS, metrics, n_bits, weights)


def distances(hashes: DataFrame, metrics: Sequence[Metric], n_bits: int = 64, n_samples: int | None = None, seed: int = 42, weights: dict | None = None) -> DataFrame:
    """Intra and inter similarities in one long table. n_samples defaults to inter_sample_size of the files."""
    if n_samples is None:
        n_samples = inter_sample_size(hashes.select("file_id").distinct().count())
    sample = sample_files(hashes, n_samples, seed)
    return intra_similarities(hashes, metrics, n_bits, weights).unionByName(inter_similarities(hashes, sample, metrics, n_bits, weights))


def wide_distances(long: DataFrame, transforms: Sequence[str]) -> DataFrame:
    """One similarity column for each transform."""
    return long.groupBy("file_a", "file_b", "algo", "metric", "class").pivot("transform", list(transforms)).agg(F.first("similarity"))


def triplets(spark, algorithms: Sequence[str], transforms: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """algorithm x transform (without the original) x metric."""
    a, t, m = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for xs, n in ((algorithms, "algo"), ([x for x in transforms if x != ORIG], "transform"), (metrics, "metric")))
    return a.crossJoin(t).crossJoin(m)

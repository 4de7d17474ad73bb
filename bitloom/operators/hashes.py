"""Hash operators: grid cells to bits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bitloom.functions import bits as B
from bitloom.operators.transforms import SIDE

#: Decimals to which transform coefficients are rounded before they are compared, so that ties do not depend on the order of sums.
DECIMALS = 9


def _mean(px: Column, n: int) -> Column:
    return F.round(F.aggregate(px, F.lit(0.0), lambda s, x: s + x) / float(n), DECIMALS)


def _median(values: Column, n: int) -> Column:
    s = F.array_sort(values)
    return F.get(s, F.lit(n // 2)) if n % 2 else (F.get(s, F.lit(n // 2 - 1)) + F.get(s, F.lit(n // 2))) / 2.0


def _above(values: Column, bound: Callable[[Column], Column]) -> Column:
    """values[i] > bound(values); values is bound once."""
    return F.get(F.transform(F.array(values), lambda v: F.get(F.transform(F.array(bound(v)), lambda m: F.transform(v, lambda x: x > m)), F.lit(0))), F.lit(0))


def sign_hash(px: Column, side: int = SIDE) -> Column:
    """bit = value >= 0: the last step of projection hashes, for vectors that are already projected."""
    return F.transform(px, lambda x: x >= 0)


def project_sign_hash(vector: Column, matrix: Sequence[Sequence[float]], pad: int = 0) -> Column:
    """bit = (matrix x vector) >= 0, with pad copies of the projection's mean on either side."""
    dot = lambda row: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in row)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    out = F.array(*(dot(r) for r in matrix))
    if pad:
        mean = _mean(out, len(matrix))
        out = F.concat(F.array_repeat(mean, pad), out, F.array_repeat(mean, pad))
    return F.transform(out, lambda x: x >= 0)


def average_hash(px: Column, side: int = SIDE, statistic: str = "mean") -> Column:
    n = side * side
    rounded = F.transform(px, lambda x: F.round(x, DECIMALS))
    return _above(rounded, (lambda v: _median(v, n)) if statistic == "median" else (lambda v: _mean(v, n)))


def difference_hash(px: Column, side: int = SIDE, vertical: bool = False) -> Column:
    """bit = the next cell to the right (below) is larger; the last one is compared with the first of its line."""
    nxt = (lambda y, x: (y + 1) % side * side + x) if vertical else (lambda y, x: y * side + (x + 1) % side)
    r = lambda i: F.round(F.get(px, F.lit(i)), DECIMALS)
    return F.array(*(r(nxt(y, x)) > r(y * side + x) for y in range(side) for x in range(side)))


def cosine_matrix(side: int = SIDE) -> list[list[float]]:
    """Rows of the two-dimensional cosine transform of a side x side grid, unscaled."""
    line = [[math.cos(math.pi * u * (2 * x + 1) / (2 * side)) for x in range(side)] for u in range(side)]
    return [[line[v][y] * line[u][x] for y in range(side) for x in range(side)] for v in range(side) for u in range(side)]


def perceptual_hash(px: Column, side: int = SIDE) -> Column:
    """bit = cosine coefficient > median of the coefficients. The transform goes over rows and then over columns: 2 side^3 products."""
    lines = F.array(*(F.array(*(F.lit(math.cos(math.pi * u * (2 * x + 1) / (2 * side))) for x in range(side))) for u in range(side)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    starts = F.array(*(F.lit(y * side + 1) for y in range(side)))
    half = F.transform(lines, lambda r: F.transform(starts, lambda y: dot(r, F.slice(px, y, side))))  # by column frequency, then by row
    # half is bound once, as the variable of a one-element transform.
    coef = F.get(F.transform(F.array(half), lambda h: F.flatten(F.transform(lines, lambda r: F.transform(h, lambda c: F.round(dot(r, c), DECIMALS))))), F.lit(0))
    return _above(coef, lambda v: _median(v, side * side))


def wavelet_hash(px: Column, side: int = SIDE) -> Column:
    """bit = Haar approximation at the grid's scale, without its mean, > median."""
    n = side * side
    ll = F.get(F.transform(F.array(_mean(px, n)), lambda m: F.transform(px, lambda x: F.round(x - m, DECIMALS))), F.lit(0))
    return _above(ll, lambda v: _median(v, n))


@dataclass(frozen=True)
class Algorithm:
    name: str
    function: Callable[..., Column]
    n_bits: int = SIDE * SIDE


ALGORITHMS: dict[str, Algorithm] = {
    a.name: a for a in (
        Algorithm("sign", sign_hash), Algorithm("average", average_hash), Algorithm("dhash", difference_hash),
        Algorithm("dhash_vertical", lambda px: difference_hash(px, vertical=True)), Algorithm("phash", perceptual_hash), Algorithm("wave", wavelet_hash),
    )
}


def register_algorithm(name: str, function: Callable[..., Column], n_bits: int) -> None:
    ALGORITHMS[name] = Algorithm(name, function, n_bits)


def list_algorithms() -> list[str]:
    return sorted([*ALGORITHMS, "colour", "pdq"])


def hash_variants(variants: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Long hashes (file_id, transform, algo, hash, packed) of variants(file_id, transform, px)."""
    made = [F.struct(F.lit(a).alias("algo"), ALGORITHMS[a].function(F.col("px")).alias("hash")) for a in algorithms]
    out = variants.select("file_id", "transform", F.explode(F.array(*made)).alias("h")).select("file_id", "transform", "h.algo", "h.hash")
    sizes = {ALGORITHMS[a].n_bits for a in algorithms}
    packed = None
    for n in sorted(sizes):
        packed = F.when(F.size("hash") == n, B.pack(F.col("hash"), n)) if packed is None else packed.when(F.size("hash") == n, B.pack(F.col("hash"), n))
    return out.where("hash is not null and not exists(hash, x -> x is null)").withColumn("packed", packed)


def drop_bad_files(hashes: DataFrame) -> DataFrame:
    """Drop every row of a file that has an all-zero hash in any variant of any algorithm."""
    bad = hashes.where("not exists(hash, x -> x)").select("file_id").distinct()
    return hashes.join(bad, "file_id", "left_anti")


def bad_file_counts(hashes: DataFrame) -> DataFrame:
    """(algo, bad_files) for every algorithm."""
    return hashes.groupBy("algo").agg(F.count_distinct(F.when(~F.exists("hash", lambda x: x), F.col("file_id"))).alias("bad_files"))


def wide(hashes: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """One row for each file and transform, one bit string column for each algorithm."""
    return hashes.groupBy("file_id", "transform").pivot("algo", list(algorithms)).agg(F.first(B.bit_string(F.col("hash"))))


def save_dims(dims: DataFrame, path: str) -> None:
    """Write label_dims as Parquet, for decode_labels in a later session."""
    dims.write.mode("overwrite").parquet(path)


def load_dims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dim string, code int, label string").parquet(path)


def decode_labels(df: DataFrame, dims: DataFrame, dim: str, column: str) -> DataFrame:
    """df with the codes of column replaced by the labels of one dimension; null and unknown codes are null."""
    known = dims.where(F.col("dim") == dim).select(F.col("code").alias(column), F.col("label").alias(f"{column}_label"))
    out = df.join(known, column, "left")
    return out.select(*(F.col(f"{column}_label").alias(c) if c == column else F.col(c) for c in df.columns))


def dropped_files(images: DataFrame, hashes: DataFrame, column: str = "file_id") -> int:
    """Number of files that hash_variants or drop_bad_files left out."""
    return images.select(column).distinct().join(hashes.select(column).distinct(), column, "left_anti").count()


def label_dims(hashes: DataFrame) -> DataFrame:
    """(dim, code, label): dense codes of the sorted labels of files, transforms and algorithms, and the fixed classes."""
    from pyspark.sql.window import Window

    def dim(name: str, column: Column) -> DataFrame:
        return hashes.select(column.cast("string").alias("label")).distinct().select(F.lit(name).alias("dim"), (F.dense_rank().over(Window.orderBy("label")) - 1).alias("code"), "label")

    classes = hashes.sparkSession.createDataFrame([("c", 0, "Inter (0)"), ("c", 1, "Intra (1)")], "dim string, code int, label string")
    return dim("f", F.col("file_id")).unionByName(dim("t", F.col("transform"))).unionByName(dim("a", F.col("algo"))).unionByName(classes)

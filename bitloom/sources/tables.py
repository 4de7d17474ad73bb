"""Tables in and out: hashes, distances, dimensions, bit strings, file lists, random pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bitloom.functions import bits as B


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd; hashes and distances at scale are partitioned by algo and transform."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_hash_csv(hashes: DataFrame, path: str) -> None:
    """Long hashes as compressed CSV; a hash is its bit string."""
    hashes.select("file_id", "transform", "algo", B.bit_string(F.col("hash")).alias("hash")).write.mode("overwrite").option("header", True).option("compression", "bzip2").csv(path)


def read_hash_csv(spark: SparkSession, path: str, n_bits: int = 64) -> DataFrame:
    raw = spark.read.schema("file_id long, transform string, algo string, hash string").option("header", True).csv(path)
    out = raw.withColumn("hash", B.from_bit_string(F.col("hash")))
    return out.withColumn("packed", B.pack(F.col("hash"), n_bits))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def only_listed(files: DataFrame, spark: SparkSession, list_path: str, column: str = "filename") -> DataFrame:
    """Rows whose file name is a line of a text file."""
    wanted = spark.read.text(list_path).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()
    return files.join(wanted, column, "left_semi")


def file_batches(files: DataFrame, batch_size: int = 100_000, column: str = "filename") -> DataFrame:
    """A batch number (0 ...) for each row: near-equal batches of at most about batch_size, by a hash of the name.

    Spark needs no batches; this is for hand-over to other systems.
    """
    n = files.count()
    batches = max(1, -(-n // batch_size))
    return files.withColumn("batch", F.pmod(F.xxhash64(column), F.lit(batches)).cast("int"))


def random_hash_pairs(spark: SparkSession, n: int, n_bits: int = 64, seed: int = 42) -> DataFrame:
    """(pair_id, u, v): n pairs of random packed hashes, none of them zero; the same on any partitioning."""
    words = -(-n_bits // 64)
    last = (1 << (n_bits - 64 * (words - 1))) - 1

    def one(side: int) -> Column:
        parts = []
        for w in range(words):
            x = F.xxhash64(F.col("id"), F.lit(side), F.lit(w), F.lit(seed))
            x = x.bitwiseAND(F.lit(B.signed(last)).cast("long")) if w == words - 1 and last != 2**64 - 1 else x
            parts.append(F.when(x == 0, F.lit(1).cast("long")).otherwise(x) if w == 0 else x)
        return F.array(*parts)

    return spark.range(n).select(F.col("id").alias("pair_id"), one(0).alias("u"), one(1).alias("v"))

"""Streams of new vectors or images through the stateless hash projection, against known hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.functions import bits as B
from bitloom.operators.hashes import ALGORITHMS


def stream_vectors(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>, label int") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_hashes(vectors: DataFrame, algorithm: str = "sign") -> DataFrame:
    """(file_id, packed) of a stream (or table) of vectors; no state, so any number of executors takes part."""
    a = ALGORITHMS[algorithm]
    px = F.transform("embedding", lambda x: x.cast("double"))
    h = vectors.where(F.size("embedding") == a.n_bits).select(F.col("vec_id").alias("file_id"), a.function(px).alias("hash"))
    return h.select("file_id", B.pack(F.col("hash"), a.n_bits).alias("packed"))


def match_known(stream: DataFrame, known: DataFrame, radius: int = 3) -> DataFrame:
    """(file_id, known_id, distance) for 64-bit hashes within radius (0 to 3) of a known one.

    A stream-static equi join on the four 16-bit blocks: hashes within 3 bits agree in one
    of them, and the first such block reports the pair.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")

    def blocks(df: DataFrame, name: str, word: str) -> DataFrame:
        w = F.get("packed", F.lit(0))
        parts = [F.shiftrightunsigned(w, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
        return df.select(F.col("file_id").alias(name), w.alias(word), F.posexplode(F.array(*parts)).alias("block", "value"))

    j = blocks(stream, "file_id", "w1").join(blocks(known, "known_id", "w2"), ["block", "value"])
    x = F.col("w1").bitwiseXOR(F.col("w2"))
    first = F.coalesce(*(F.when(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) == 0, F.lit(i)) for i in range(4)))
    return j.where((first == F.col("block")) & (F.bit_count(x) <= radius)).select("file_id", "known_id", F.bit_count(x).alias("distance"))

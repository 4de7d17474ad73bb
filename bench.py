"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from bitloom.functions.metrics import make_metrics
from bitloom.plans import workload as W
from bitloom.session import get_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from bitloom.sources.tables import random_hash_pairs

    def pairs_100k(spec):
        """W1: 100,000 random pairs under one metric."""
        def run(s, _):
            m = make_metrics({"m": spec})[0]
            u, v = ([F.get(c, F.lit(0))] for c in ("u", "v"))
            return random_hash_pairs(s, 100_000).select(F.avg(m.distance(u, v, 64)).alias("mean"))
        return run

    ones = [[1.0] * 4] * 4
    runs = {
        "w1_hatched": pairs_100k(("hatched_matrix2", {"distance": "hamming"})), "w1_convolution": pairs_100k(("convolution_distance", {"filter": ones})),
        "w1_ngram": pairs_100k("ngram_cosine_distance"), "w1_hatched_fast": pairs_100k("hatched_matrix_fast"), "w1_hamming": pairs_100k("hamming"),
        "w2_metrics_triplet": W.metrics_triplet, "w3_bit_weights_second_pass": W.metrics_weighted,
        "w4_stability": lambda s, d: W.sample_stability(s, d, sizes=(100, 250, 500, 1000), iterations=10),
    }
    took = {}
    for name, f in runs.items():
        if name.startswith("w1_"):
            f(spark, sf).collect()  # compiled once before it is timed
        t = time.time()
        f(spark, sf).collect()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

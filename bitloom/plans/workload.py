"""Engine queries over the driver's tables: each embedding is an 8 x 8 grey grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.functions import bits as B
from bitloom.functions.metrics import Metric, make_metrics
from bitloom.operators import bitanalysis, evaluate, hashes as H, pairs as P, stats as S, transforms as T
from bitloom.session import materialize, read_table, ship

BITS = 64
#: Transforms by query name, with their parameters.
GRID = {
    "flip_h": T.flip("horizontal"), "flip_v": T.flip("vertical"), "rotate90": T.rotate(90), "rotate15": T.rotate(15), "border": T.border(1, 0.4), "crop": T.crop((0.125,) * 4),
    "rescale": T.rescale(0.5), "enhance": T.enhance(brightness=1.2, contrast=1.1), "blend": T.blend("Left-to-Right", 0.5), "composite": T.composite("topleft", size=(4, 4)), "watermark": T.watermark(2),
}
ALGOS = ("sign", "average", "dhash", "phash")
#: The transforms, algorithms and metrics of the evaluation queries.
EVAL_TRANSFORMS = ("crop", "rescale", "border")
EVAL_METRICS = {"hamming": "hamming", "ngram2": ("ngram_cosine_distance", {"ngram_size": 2}), "conv4": ("convolution_distance", {"filter": [[1.0] * 4] * 4}), "hatched2": ("hatched_matrix2", {"distance": "hamming"})}
#: Fixed decision thresholds (algorithm, metric).
PRESET = {("sign", "hamming"): 0.7, ("average", "hamming"): 0.75, ("phash", "conv4"): 0.65}
HAMMING_WEIGHTS = [1.0 + (i % 8) / 8 for i in range(BITS)]
#: Metrics of the pair queries: name, parameters, weights.
DISTANCES: dict[str, tuple[str, dict, Sequence[float] | None]] = {
    **{m: (m, {}, None) for m in ("hamming", "cosine", "jaccard", "dice", "rogerstanimoto", "russellrao", "sokalsneath", "yule", "kulczynski1", "cityblock", "euclidean", "chebyshev", "correlation", "jensenshannon", "braycurtis", "sokalmichener", "sqeuclidean", "canberra")},
    "minkowski3": ("minkowski", {"p": 3.0}, None),
    "seuclidean": ("seuclidean", {"V": [0.25 - 0.001 * (i % 16) for i in range(BITS)]}, None),
    "hamming_weighted": ("hamming", {}, HAMMING_WEIGHTS),
    "cosine_weighted": ("cosine", {}, HAMMING_WEIGHTS),
    "ngram2": ("ngram_cosine_distance", {"ngram_size": 2}, None),
    "ngram3": ("ngram_cosine_distance", {"ngram_size": 3}, None),
    "conv3": ("convolution_distance", {}, None),
    "conv4": ("convolution_distance", {"filter": [[1.0] * 4] * 4}, None),
    "conv_similar": ("convolution_distance", {"mode": "sum_similar"}, None),
    "hatched_hamming": ("hatched_matrix", {"distance": "hamming"}, None),
    "hatched_cosine": ("hatched_matrix", {"distance": "cosine"}, None),
    "hatched2_cosine": ("hatched_matrix2", {"distance": "cosine"}, None),
    "hatched_fast": ("hatched_matrix_fast", {}, None),
}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids; a table of few files is dealt over all cores first, since hashing costs far more than reading."""
    e, cores = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), spark.sparkContext.defaultParallelism
    return (e.repartition(cores) if e.rdd.getNumPartitions() < cores else e).select(F.col("vec_id").alias("file_id"), F.transform("embedding", lambda x: x.cast("double")).alias("px"))


def hash_table(spark: SparkSession, sf_dir: str, transforms: Sequence[str] = (), algos: Sequence[str] = ALGOS) -> DataFrame:
    return H.drop_bad_files(H.hash_variants(T.variants(images(spark, sf_dir), [GRID[t] for t in transforms]), algos))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits: sums in another order are the same result."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _bits(df: DataFrame) -> DataFrame:
    return df.withColumn("bits", B.bit_string(F.col("hash"))).drop("hash", "packed")


def one_hash(algo: str) -> Callable:
    return lambda spark, sf: _bits(H.hash_variants(T.variants(images(spark, sf), []), [algo])).select("file_id", "bits")


def one_transform(name: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = T.variants(images(spark, sf), [GRID[name]]).where(F.col("transform") != T.ORIG)
        return v.select("file_id", "transform", F.posexplode("px").alias("cell", "value")).select("file_id", "transform", "cell", F.round("value", 6).alias("value"))
    return run


def sampled(h: DataFrame) -> DataFrame:
    return P.sample_files(h, P.inter_sample_size(h.select("file_id").distinct().count()))


def one_distance(name: str) -> Callable:
    """The distance of each file's sign hash to that of its crop, and of all sampled pairs."""
    metric, kwargs, weights = DISTANCES[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        h = hash_table(spark, sf, ["crop"], ["sign"])
        m = [Metric(name, make_metrics({name: (metric, kwargs)})[0].function, kwargs)]
        w = {("sign", name): weights} if weights else None
        d = P.intra_similarities(h, m, BITS, w).where(F.col("transform") != T.ORIG).unionByName(P.inter_similarities(h, sampled(h), m, BITS, w))
        return d.select("file_a", "file_b", "transform", "class", F.round(1.0 - F.col("similarity"), 6).alias("distance"))
    return run


def eval_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hashes of the evaluation, written once and read by all that follows."""
    return H.drop_bad_files(materialize(H.hash_variants(T.variants(images(spark, sf), [GRID[t] for t in EVAL_TRANSFORMS]), ALGOS), "hashes"))


def distance_table(spark: SparkSession, sf: str, weights: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(hashes, distances) of the evaluation."""
    h = eval_hashes(spark, sf)
    return h, P.distances(h, make_metrics(EVAL_METRICS), BITS, weights=weights)


def score_histogram(spark: SparkSession, sf: str, weights: dict | None = None) -> DataFrame:
    return materialize(evaluate.histogram(distance_table(spark, sf, weights)[1]), "histogram")


def preset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, m, t) for (a, m), t in PRESET.items()], "algo string, metric string, threshold double")


def metrics_triplet(spark: SparkSession, sf: str, **kwargs) -> DataFrame:
    return evaluate.metrics(score_histogram(spark, sf), **kwargs)


def _confusion(spark: SparkSession, sf: str, normalize: str | None, weighted: bool) -> DataFrame:
    h = score_histogram(spark, sf)
    t = evaluate.eer(evaluate.roc_points(h)).select(*evaluate.TRIPLET, F.col("eer_threshold").alias("threshold"))
    return evaluate.confusion(h, t, normalize, weighted)


def _frequencies(h: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(histogram, bit frequencies at the EER threshold) of distances d between hashes h; d is written once."""
    d = materialize(d, "distances")
    hist = materialize(evaluate.histogram(d), "histogram")
    t = evaluate.eer(evaluate.roc_points(hist)).select(*evaluate.TRIPLET, F.col("eer_threshold").alias("threshold"))
    return hist, bitanalysis.bit_frequencies(d, h, materialize(t, "thresholds"), BITS)


def bit_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(*distance_table(spark, sf))[1]


def _two_passes(spark: SparkSession, sf: str, metric: str = "hamming") -> tuple[DataFrame, DataFrame]:
    """Histograms of a plain and of a weighted pass of one metric over the same hashes; no other metric is scored."""
    h, m = eval_hashes(spark, sf), make_metrics({metric: EVAL_METRICS[metric]})
    hist, freq = _frequencies(h, P.distances(h, m, BITS))
    w = bitanalysis.weight_vectors(bitanalysis.bit_weights(freq))
    return hist, materialize(evaluate.histogram(P.distances(h, m, BITS, weights=w)), "histogram")


def metrics_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_two_passes(spark, sf)[1])


def auc_improvement(spark: SparkSession, sf: str) -> DataFrame:
    plain, weighted = _two_passes(spark, sf)
    return S.improvement(evaluate.metrics(plain), evaluate.metrics(weighted))


def sample_stability(spark: SparkSession, sf: str, sizes: Sequence[int] = (100, 250), iterations: int = 3) -> DataFrame:
    """AUC and EER of the sign hash under Hamming by sample size and iteration.

    The draws are data: one row for each (size, iteration, file), so all of them go through
    one plan with two more keys.
    """
    from pyspark.sql.window import Window

    h = materialize(hash_table(spark, sf, ["crop", "rescale"], ["sign"]), "hashes")
    draws = spark.createDataFrame([(s, i, P.inter_sample_size(s)) for s in sizes for i in range(iterations)], "sample_size int, iteration int, n_inter int")
    order = F.md5(F.concat_ws(":", F.col("sample_size"), F.col("iteration"), F.col("file_id")))
    files = h.select("file_id").distinct().crossJoin(F.broadcast(draws)).withColumn("o", order)
    files = files.withColumn("rn", F.row_number().over(Window.partitionBy("sample_size", "iteration").orderBy("o", "file_id"))).where("rn <= sample_size")
    files = materialize(files.select("sample_size", "iteration", "file_id", (F.col("rn") <= F.col("n_inter")).alias("inter")), "draws")
    m = make_metrics({"hamming": "hamming"})
    intra = P.intra_similarities(h, m).join(files.select("sample_size", "iteration", F.col("file_id").alias("file_a")), "file_a")
    a = files.where("inter").select("sample_size", "iteration", F.col("file_id").alias("file_a"))
    b = files.where("inter").select("sample_size", "iteration", F.col("file_id").alias("file_b"))
    left = h.select(F.col("file_id").alias("file_a"), "transform", F.col("packed").alias("pu")).join(a, "file_a")
    right = h.select(F.col("file_id").alias("file_b"), "transform", F.col("packed").alias("pv")).join(b, "file_b")
    pairs = left.join(right, ["sample_size", "iteration", "transform"]).where("file_a < file_b").withColumn("algo", F.lit("sign")).withColumn("class", F.lit(0))
    inter = P._similarities(pairs, [*P.KEYS, "sample_size", "iteration"], m, BITS, None)
    both = intra.unionByName(inter).where(F.col("transform") != T.ORIG).withColumn("s", F.bround("similarity", evaluate.DECIMALS))
    keys = [*evaluate.TRIPLET, "sample_size", "iteration"]
    hist = both.groupBy(*keys, "s").agg(F.sum(F.when(F.col("class") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).alias("n"))
    points = evaluate.roc_points(materialize(hist, "histogram"), keys)
    return evaluate.auc(points, keys).join(evaluate.eer(points, keys), keys).select("transform", "sample_size", "iteration", "auc", "eer", "eer_threshold")


def label_roc(spark: SparkSession, sf: str, block: int = 1024) -> DataFrame:
    """AUC of the sign hash's Hamming similarity for equal labels, over all pairs of all vectors.

    Equal hashes of one label are one entry with a count. Every pair of blocks of entries is a
    task of its own, of which only a histogram of 65 similarities leaves. Null labels are left out.
    """
    ship(spark)
    v = read_table(spark, sf, "embeddings").where("label is not null and embedding is not null")
    v = v.select(F.col("label").cast("string").alias("label"), F.get(B.pack(H.sign_hash(F.col("embedding")), BITS), F.lit(0)).alias("p")).where("p is not null")
    entries = materialize(v.groupBy("label", "p").agg(F.count("*").alias("w")), "entries")
    blocks = -(-entries.count() // block) or 1
    own = F.pmod(F.xxhash64("label", "p"), F.lit(blocks)).cast("int")
    sides = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = sides.select("label", "p", "w", "own", (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("pair"))
    hist = sides.groupBy("pair").applyInPandas(_pair_histogram, "d int, y long, n long").groupBy("d").agg(F.sum("y").alias("p"), F.sum("n").alias("n"))
    hist = hist.select(F.lit("sign").alias("algo"), F.lit("label").alias("transform"), F.lit("hamming").alias("metric"), (1 - F.col("d") / 64.0).alias("s"), "p", "n")
    points = evaluate.roc_points(hist)
    return evaluate.auc(points).join(evaluate.eer(points), list(evaluate.TRIPLET)).select("algo", "auc", "eer", "eer_threshold")


def _pair_histogram(rows: pd.DataFrame) -> pd.DataFrame:
    """(d, y, n): pairs at Hamming distance d with equal and with different labels; of one block with itself each pair once."""
    own, w, p = rows["own"].to_numpy(), rows["w"].to_numpy(), rows["p"].to_numpy().view(np.uint64)
    label = np.unique(rows["label"].to_numpy().astype(str), return_inverse=True)[1]
    a = np.flatnonzero(own == own.min())
    two = own.min() != own.max()
    b = np.flatnonzero(own != own.min()) if two else a
    equal, other = np.zeros(65), np.zeros(65)
    for i in range(0, len(a), 256):
        x = a[i : i + 256]
        d, n, same = np.bitwise_count(p[x][:, None] ^ p[b][None]), w[x][:, None] * w[b][None].astype(float), label[x][:, None] == label[b][None]
        equal += np.bincount(d[same], n[same], 65)
        other += np.bincount(d[~same], n[~same], 65)
    if not two:  # ordered pairs, and each entry with itself
        equal[0] -= w.sum()
        equal, other = equal / 2, other / 2
    return pd.DataFrame({"d": np.arange(65, dtype=np.int32), "y": np.rint(equal).astype(np.int64), "n": np.rint(other).astype(np.int64)}).query("y > 0 or n > 0")


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    bits = one_hash("sign")(spark, sf)
    h = bits.select("file_id", B.from_bit_string(F.col("bits")).alias("hash"))
    return h.select("file_id", F.size("hash").alias("n_bits"), F.size(F.filter("hash", lambda x: x)).alias("popcount"), B.bit_string(F.col("hash")).alias("bits"))


def _file_join(spark: SparkSession, sf: str) -> DataFrame:
    """Variants from a second scan, joined by file name: here the crops of all files."""
    name = F.concat(F.lit("img_"), F.col("file_id").cast("string"), F.lit(".png"))
    h = _bits(hash_table(spark, sf, [], ["sign"])).withColumn("filename", name).withColumnRenamed("bits", "hash")
    other = _bits(hash_table(spark, sf, ["crop"], ["sign"])).where(F.col("transform") != T.ORIG).withColumn("transform", F.lit(T.ORIG)).withColumn("filename", name).withColumnRenamed("bits", "hash")
    return T.with_disk_variants(h, other, "from_disk").select("filename", "transform", F.col("hash").alias("bits"))


def _random_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from bitloom.sources.tables import random_hash_pairs

    u, v = (F.col(c) for c in ("u", "v"))
    d = random_hash_pairs(spark, 1000, BITS)
    return d.select("pair_id", (F.bit_count(F.get(u, F.lit(0)).bitwiseXOR(F.get(v, F.lit(0)))) / 64.0).alias("hamming"))


def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    h = hash_table(spark, sf, ["crop"], ["sign"])
    m = lambda intra: [Metric("synthetic", make_metrics({"x": "test_synthetic"})[0].function, {"intra": intra})]
    return P.intra_similarities(h, m(True)).unionByName(P.inter_similarities(h, sampled(h), m(False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable] = {f"hash_{a}": one_hash(a) for a in H.ALGORITHMS}
    q |= {f"transform_{t}": one_transform(t) for t in GRID}
    q |= {f"dist_{d}": one_distance(d) for d in DISTANCES}
    algo, names = ["algo"], [GRID[t].name for t in EVAL_TRANSFORMS]
    dist = lambda s, d: distance_table(s, d)[1]
    points = lambda s, d: evaluate.roc_points(score_histogram(s, d))
    q |= {
        "hash_bitstring": _round_trip,
        "hash_popcount_bad": lambda s, d: H.bad_file_counts(H.hash_variants(T.variants(images(s, d), [GRID["border"], GRID["rotate15"]]), ALGOS)),
        "hash_long_all": lambda s, d: _bits(hash_table(s, d, EVAL_TRANSFORMS)),
        "hash_wide_pivot": lambda s, d: H.wide(hash_table(s, d, ["crop"]), ALGOS),
        "label_dims": lambda s, d: H.label_dims(hash_table(s, d, EVAL_TRANSFORMS)),
        "transform_file_join": _file_join,
        "random_pairs": _random_pairs,
        "dist_synthetic": _synthetic,
        "pairs_intra": lambda s, d: tidy(P.intra_similarities(hash_table(s, d, EVAL_TRANSFORMS), make_metrics({"hamming": "hamming"}))),
        "pairs_inter_sampled": lambda s, d: (lambda h: tidy(P.inter_similarities(h, sampled(h), make_metrics({"hamming": "hamming"}))))(materialize(hash_table(s, d, EVAL_TRANSFORMS), "hashes")),
        "distances_union": lambda s, d: tidy(dist(s, d)),
        "distances_wide": lambda s, d: tidy(P.wide_distances(dist(s, d).where("metric = 'hamming'"), [T.ORIG, *names])),
        "triplets": lambda s, d: P.triplets(s, ALGOS, [T.ORIG, *names], list(EVAL_METRICS)),
        "roc_points": lambda s, d: tidy(points(s, d).where("threshold < 2").select(*evaluate.TRIPLET, "threshold", "fpr", "tpr")),
        "auc": lambda s, d: tidy(evaluate.auc(points(s, d))),
        "eer": lambda s, d: tidy(evaluate.eer(points(s, d))),
        "fpr_threshold": lambda s, d: tidy(evaluate.fpr_threshold(points(s, d), 0.05)),
        "cm_rates": lambda s, d: tidy(_confusion(s, d, "true", False)),
        "cm_counts": lambda s, d: tidy(_confusion(s, d, None, False)),
        "cm_weighted": lambda s, d: tidy(_confusion(s, d, None, True)),
        "metrics_triplet": lambda s, d: tidy(metrics_triplet(s, d)),
        "metrics_preset_threshold": lambda s, d: tidy(metrics_triplet(s, d, preset=preset(s))),
        "bit_freq": lambda s, d: tidy(bit_frequency(s, d)),
        "bit_weights": lambda s, d: tidy(bitanalysis.bit_weights(bit_frequency(s, d))),
        "bit_weights_mean": lambda s, d: tidy(bitanalysis.bit_weights(bit_frequency(s, d), "mean")),
        "metrics_weighted": lambda s, d: tidy(metrics_weighted(s, d)),
        "auc_improvement": lambda s, d: tidy(auc_improvement(s, d)),
        "dist_stats": lambda s, d: tidy(S.describe(dist(s, d))),
        "inter_summary": lambda s, d: S.inter_summary(dist(s, d)),
        "auc_by_algo": lambda s, d: tidy(S.by_group(metrics_triplet(s, d), algo)),
        "auc_grouping_sets": lambda s, d: tidy(S.by_grouping_sets(metrics_triplet(s, d))),
        "auc_overall": lambda s, d: tidy(S.overall(metrics_triplet(s, d))),
        "auc_pivot": lambda s, d: tidy(S.auc_pivot(metrics_triplet(s, d), names)),
        "auc_vs_baseline": lambda s, d: S.versus_baseline(tidy(metrics_triplet(s, d)), "hamming"),
        "sample_stability": lambda s, d: tidy(sample_stability(s, d)),
        "stability_letter_values": lambda s, d: tidy(S.letter_values(sample_stability(s, d), ["sample_size"], "eer_threshold")),
        "hist_bins": lambda s, d: tidy(S.histogram_bins(dist(s, d))),
        "kde_grid": lambda s, d: tidy(S.density(dist(s, d).where("metric = 'hamming'"), 21), 4),
        "eer_curve": lambda s, d: tidy(S.error_curves(points(s, d))),
        "label_roc": lambda s, d: tidy(label_roc(s, d)),
    }
    return q

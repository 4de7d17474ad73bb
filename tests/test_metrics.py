"""Golden vectors and properties of the distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions.metrics import BUILT_IN, CUSTOM, NORMALISED, Metric, make_metrics, max_convolution_value
from bitloom.operators.pairs import inter_sample_size

CHK = [(i // 8 + i % 8) % 2 == 0 for i in range(64)]
A2 = [not b if i < 8 else b for i, b in enumerate(CHK)]
LEFT, TOP = [i % 8 < 4 for i in range(64)], [i < 32 for i in range(64)]
C2 = [not b if i in (0, 9) else b for i, b in enumerate(CHK)]
ONES4 = [[1.0] * 4] * 4
GOLDEN = {
    ("hamming", ()): (0.125, 0.5, 0.03125), ("cosine", ()): (0.125, 0.5, 0.031754163448145856), ("jaccard", ()): (0.2222222222222222, 0.6666666666666666, 0.0625),
    ("dice", ()): (0.125, 0.5, 0.03225806451612903), ("rogerstanimoto", ()): (0.2222222222222222, 0.6666666666666666, 0.06060606060606061), ("russellrao", ()): (0.5625, 0.75, 0.53125),
    ("sokalsneath", ()): (0.36363636363636365, 0.8, 0.11764705882352941), ("yule", ()): (0.04, 1.0, 0.0), ("correlation", ()): (0.25, 1.0, 0.06066356337227574),
    ("ngram_cosine_distance", ()): (0.0714, 0.5, 0.0258), ("convolution_distance", ()): (0.0909, 0.5, 0.0269),
    ("hatched_matrix", (("distance", "hamming"),)): (0.0625, 0.5, 0.0312), ("hatched_matrix2", (("distance", "hamming"),)): (0.0625, 0.5, 0.0312),
}


def packed(h):
    return [F.lit(x).cast("long") for x in B.words_mask([i for i, b in enumerate(h) if b], len(h))]


def value(spark, column):
    return spark.range(1).select(column.alias("d")).first().d


def test_golden_vectors(spark):
    known = {**BUILT_IN, **CUSTOM}
    cols, expected = [], []
    for (name, kwargs), values in GOLDEN.items():
        for (u, v), x in zip(((CHK, A2), (LEFT, TOP), (CHK, C2)), values):
            cols.append(known[name](packed(u), packed(v), 64, None, **dict(kwargs)).alias(f"c{len(cols)}"))
            expected.append((name, x))
    got = spark.range(1).select(*cols).first()
    for g, (name, x) in zip(got, expected):
        assert g == pytest.approx(x, abs=1e-12), name


def test_properties(spark):
    rng = np.random.default_rng(3)
    hs = rng.random((6, 64)) < 0.5
    rows = [(i, j, [bool(b) for b in hs[i]], [bool(b) for b in hs[j]]) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "i int, j int, u array<boolean>, v array<boolean>")
    df = df.withColumn("pu", B.pack(F.col("u"), 64)).withColumn("pv", B.pack(F.col("v"), 64))
    u, v = [F.get("pu", F.lit(0))], [F.get("pv", F.lit(0))]
    known = {**BUILT_IN, **CUSTOM}
    got = df.select("i", "j", *(known[m](u, v, 64, None).alias(m) for m in NORMALISED)).collect()
    at = {(r.i, r.j): r for r in got}
    for (i, j), r in at.items():
        for m in NORMALISED:
            assert -1e-12 <= r[m] <= 1 + 1e-12, m
            assert r[m] == pytest.approx(at[j, i][m], abs=1e-12)
            if i == j and m != "russellrao":
                assert r[m] == pytest.approx(0, abs=1e-7), m


def test_weighted_and_wide_hashes(spark):
    rng = np.random.default_rng(4)
    for n in (64, 100, 256):
        u, v, w = rng.random(n) < 0.5, rng.random(n) < 0.5, rng.random(n)
        pu, pv = packed(u), packed(v)
        assert value(spark, BUILT_IN["hamming"](pu, pv, n, list(w))) == pytest.approx(w[u != v].sum() / w.sum())
        assert value(spark, BUILT_IN["cosine"](pu, pv, n, list(w))) == pytest.approx(1 - w[u & v].sum() / math.sqrt(w[u].sum() * w[v].sum()))
    with pytest.raises(ValueError):
        CUSTOM["ngram_cosine_distance"](packed([True] * 42), packed([True] * 42), 42)


def test_ngram_and_convolution_by_brute_force(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        u, v = rng.random(64) < 0.5, rng.random(64) < 0.5
        U, V = u.reshape(8, 8), v.reshape(8, 8)
        x, y = (np.concatenate([m[i : i + 3, j : j + 3].ravel() for i in range(6) for j in range(6)]).astype(float) for m in (U, V))
        d = value(spark, CUSTOM["ngram_cosine_distance"](packed(u), packed(v), 64, ngram_size=3))
        assert d == pytest.approx(1 - x @ y / math.sqrt((x @ x) * (y @ y)), abs=6e-5)
        p = np.pad((U ^ V).astype(float), 1)
        s = sum(p[i : i + 3, j : j + 3].sum() for i in range(8) for j in range(8)) - 0
        d = value(spark, CUSTOM["convolution_distance"](packed(u), packed(v), 64))
        assert d == pytest.approx(s / 484, abs=6e-5)
    assert max_convolution_value(64, [[1.0] * 3] * 3) == 484 and max_convolution_value(64, ONES4) == 784


def test_validation(spark):
    with pytest.raises(ValueError):
        make_metrics({})
    with pytest.raises(ValueError, match="bad"):
        make_metrics({"ok": "hamming", "bad": "nonsense"})
    with pytest.raises(ValueError, match="maha"):
        make_metrics({"maha": "mahalanobis"})
    assert [m.name for m in make_metrics({"a": "hamming", "b": ("convolution_distance", {"filter": ONES4}), "c": ("cosine",)})] == ["a", "b", "c"]
    eye = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
    m = Metric("m", BUILT_IN["mahalanobis"], {"VI": eye})
    assert value(spark, m.distance([F.lit(0b1010).cast("long")], [F.lit(0b0001).cast("long")], 4)) == pytest.approx(math.sqrt(3))


def test_sample_size():
    assert [inter_sample_size(n) for n in (3, 4, 5, 500, 5000, 250000)] == [0, 0, 4, 33, 101, 708]
    for n in range(1, 400):
        brute = next((m for m in range(1, n) if m * (m - 1) // 2 > n), 0)
        assert inter_sample_size(n) == brute


def test_bit_strings(spark):
    r = spark.createDataFrame([("0101",), ("",), ("1x0",)], "s string").select(B.bit_string(B.from_bit_string(F.col("s"))).alias("b")).collect()
    assert [x.b for x in r] == ["0101", "", "100"]

"""Curves, thresholds and confusion against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import bitanalysis, evaluate as E, stats as S


def table(spark, y, s):
    rows = [("a", "t", "m", int(c), float(x), i, i) for i, (c, x) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "algo string, transform string, metric string, class int, similarity double, file_a long, file_b long")


def curve(spark, y, s):
    return E.roc_points(E.histogram(table(spark, y, s)))


def test_docstring_case(spark):
    p = curve(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    got = sorted(((r.fpr, r.tpr, r.threshold) for r in p.collect()), key=lambda x: -x[2])
    assert got == [(0, 0, math.inf), (0, 0.5, 0.8), (0.5, 0.5, 0.4), (0.5, 1, 0.35), (1, 1, 0.1)]
    assert E.auc(p).first().auc == 0.75
    r = E.eer(p).first()
    assert (r.eer, r.eer_threshold) == (0.5, 0.35)


def test_perfect_separation_and_one_class(spark):
    p = curve(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    r = E.metrics(E.histogram(table(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]))).first()
    assert r.auc == 1 and r.eer == 0 and math.isfinite(r.eer_threshold)
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 0, 0, 1)
    assert curve(spark, [1, 1], [0.1, 0.2]).count() == 0
    assert E.auc(p).first().auc == 1
    assert math.isfinite(E.fpr_threshold(p, 0.3).first().threshold)


def test_random_scores(spark):
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.3
    s = np.round(rng.random(300) * 0.7 + 0.3 * y, 2)
    h = E.histogram(table(spark, y, s))
    pos, neg = s[y], s[~y]
    exact = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    p = E.roc_points(h)
    assert E.auc(p).first().auc == pytest.approx(exact)
    r = E.metrics(h, normalize=None, weighted=False).first()
    t = r.decision_threshold
    assert (r.tp, r.fn, r.fp, r.tn) == ((pos >= t).sum(), (pos < t).sum(), (neg >= t).sum(), (neg < t).sum())
    rates = E.metrics(h).first()
    assert rates.tn + rates.fp == pytest.approx(1) and rates.tp + rates.fn == pytest.approx(1)
    w = E.metrics(h, normalize=None, weighted=True).first()
    assert w.tp + w.fn == pytest.approx(w.tn + w.fp)
    assert E.auc(curve(spark, y, -s)).first().auc == pytest.approx(1 - exact)
    assert E.reference_form(E.metrics(h)).columns[3:6] == ["AUC", "EER", "EER-Threshold"]
    with pytest.raises(ValueError):
        E.predict(F.lit(1.0), F.lit(0.5), 2)


def test_bit_frequencies_and_weights(spark):
    rng = np.random.default_rng(2)
    bits = {(f, t): rng.random(64) < 0.5 for f in range(6) for t in ("orig", "x")}
    from bitloom.functions import bits as B

    hashes = spark.createDataFrame([(f, t, "a", B.words_mask([i for i in range(64) if b[i]], 64)) for (f, t), b in bits.items()], "file_id long, transform string, algo string, packed array<long>")
    rows = [("a", "x", "m", 1, 0.9 if f < 4 else 0.1, f, f) for f in range(6)] + [("a", "x", "m", 0, 0.2, f, g) for f in range(6) for g in range(f)]
    d = spark.createDataFrame(rows, "algo string, transform string, metric string, class int, similarity double, file_a long, file_b long")
    t = spark.createDataFrame([("a", "x", "m", 0.5)], "algo string, transform string, metric string, threshold double")
    got = {(r.quadrant, r.bit): r.freq for r in bitanalysis.bit_frequencies(d, hashes, t).collect()}
    assert len(got) == 4 * 64
    for i in range(64):
        assert got["TP", i] == pytest.approx(np.mean([bits[f, "orig"][i] == bits[f, "x"][i] for f in range(4)]))
        assert got["FN", i] == pytest.approx(np.mean([bits[f, "orig"][i] == bits[f, "x"][i] for f in (4, 5)]))
        assert got["TN", i] == pytest.approx(np.mean([bits[f, "x"][i] != bits[g, "x"][i] for f in range(6) for g in range(f)]))
        assert got["FP", i] == 1.0
    w = bitanalysis.weight_vectors(bitanalysis.bit_weights(bitanalysis.bit_frequencies(d, hashes, t)))
    assert w["a", "m"][5] == pytest.approx(np.median([got[q, 5] for q in bitanalysis.QUADRANTS]))


def test_describe(spark):
    r = S.describe(table(spark, [0] * 4, [1, 2, 4, 8]).withColumnRenamed("class", "k")).first()
    assert (r.p25, r.p50, r.std) == (1.75, 3.0, pytest.approx(3.0956959368344514))

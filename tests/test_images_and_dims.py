"""Image transforms against plain loops, dimensions, registries and label pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import hashes as H, transforms as T
from bitloom.sources import images as I

RNG = np.random.default_rng(0)


def test_blend_is_a_ramp_between_two_images():
    x, static = RNG.integers(0, 256, (6, 10, 3)).astype(float), RNG.integers(0, 256, (6, 10, 3)).astype(float)
    for way, alpha in (("Left-to-Right", lambda r, c: int(c / 10 * 255)), ("Right-to-Left", lambda r, c: 255 - int(c / 10 * 255)), ("Up-to-Down", lambda r, c: int(r / 6 * 255)), ("Down-to-Up", lambda r, c: 255 - int(r / 6 * 255))):
        y = I.blend_image(static, way)(x)
        for r, c in itertools.product(range(6), range(10)):
            a = alpha(r, c) / 255
            assert np.allclose(y[r, c], a * x[r, c] + (1 - a) * static[r, c])
    with pytest.raises(ValueError):
        I.blend_image(static, "diagonal")


def test_composite_and_watermark_change_their_place_only():
    x, patch = np.zeros((40, 60, 3)), np.full((10, 10, 3), 200.0)
    for position, rows, cols in (("left", slice(0, 40), slice(0, 30)), ("bottom", slice(20, 40), slice(0, 60)), ("topright", slice(0, 20), slice(30, 60))):
        want = x.copy()
        want[rows, cols] = 200
        assert np.allclose(I.composite_image(patch, position, scale=True)(x), want)
    assert np.allclose(I.composite_image(patch, "left")(x), 200)
    y = I.composite_image(patch, coords=(55, -5), size=(10, 10))(x)
    assert y[:5, 55:].min() == 200 and y.sum() == 200 * 5 * 5 * 3
    mark = np.dstack([np.full((20, 30, 3), 100.0), np.full((20, 30), 127.5)])
    y = I.watermark_image(mark, min_height=20)(x)
    want = x.copy()
    want[20:, 30:] = 50
    assert np.allclose(y, want)


def test_rescale_keeps_aspect_and_never_enlarges_thumbnails():
    x = np.ones((40, 60, 3))
    assert I.rescale_image(fixed=(30, 30))(x).shape == (20, 30, 3)
    assert I.rescale_image(fixed=(400, 400))(x).shape == x.shape
    assert I.rescale_image(fixed=(7, 9), thumbnail=False)(x).shape == (7, 9, 3)
    with pytest.raises(ValueError):
        I.rescale_image(0.5, (3, 3))


def test_dims_are_saved_and_decode(spark, tmp_path):
    h = spark.createDataFrame([(7, "orig", "sign"), (9, "Crop", "phash")], "file_id long, transform string, algo string")
    H.save_dims(H.label_dims(h), str(tmp_path / "dims"))
    dims = H.load_dims(spark, str(tmp_path / "dims"))
    coded = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 3.0), (None, 4.0)], "algo int, label double")
    got = H.decode_labels(coded, dims, "a", "algo")
    assert got.columns == ["algo", "label"] and {(r.algo, r.label) for r in got.collect()} == {("phash", 1.0), ("sign", 2.0), (None, 3.0), (None, 4.0)}
    assert H.dropped_files(h, h.where("file_id = 7")) == 1


def test_variant_folder_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.scan_variant(spark, str(tmp_path / "none"))


def test_registered_transforms_are_listed():
    T.register_transform("Twice", lambda: T.identity())
    try:
        assert "Twice" in T.list_transforms()
    finally:
        del T.TRANSFORMS["Twice"]


def test_cosine_hash_equals_the_plain_transform(spark):
    grid = [RNG.normal(size=64).tolist() for _ in range(20)]
    got = [r.h for r in spark.createDataFrame([(g,) for g in grid], "px array<double>").select(H.perceptual_hash(F.col("px")).alias("h")).collect()]
    m = np.array(H.cosine_matrix())
    for g, h in zip(grid, got):
        c = np.round(m @ np.array(g), 9)
        assert h == (c > np.median(c)).tolist()


def test_label_pairs_are_counted_once(spark, tmp_path):
    from bitloom.plans import workload as W

    v = RNG.normal(size=(60, 64))
    v[10:20] = v[:10]
    rows = [(i, [float(a) for a in x], int(i % 3) if i % 7 else None) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    kept = [(np.array(x) >= 0, label) for _, x, label in rows if label is not None]
    s, y = np.array([(1 - (a[0] != b[0]).mean(), a[1] == b[1]) for a, b in itertools.combinations(kept, 2)]).T
    p, n = s[y == 1], s[y == 0]
    auc = ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))
    for block in (1024, 8):
        assert W.label_roc(spark, str(tmp_path), block=block).first().auc == pytest.approx(auc, abs=1e-9)

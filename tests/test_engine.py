"""Transforms, hashes, images, tables, streaming."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import hashes as H, transforms as T
from bitloom.sources import images as I, tables


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def grids(spark):
    rng = np.random.default_rng(0)
    return rng.normal(size=(5, 64)), lambda rows: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "file_id long, px array<double>")


def test_transforms(spark, grids):
    x, make = grids
    specs = [T.flip("horizontal"), T.flip("vertical"), T.rotate(90), T.border(1, 0.4), T.crop((0.125,) * 4), T.rescale(0.5), T.enhance(1.2, 1.1), T.blend(), T.composite("topleft"), T.watermark()]
    got = {(r.file_id, r.transform): np.array(r.px) for r in T.variants(make(x), specs).collect()}
    assert len(got) == 5 * 11
    g = x[0].reshape(8, 8)
    at = lambda s: got[0, s.name].reshape(8, 8)
    assert np.allclose(at(specs[0]), g[:, ::-1]) and np.allclose(at(specs[1]), g[::-1]) and np.allclose(at(specs[2]), np.rot90(g))
    b = g.copy()
    b[[0, -1]] = b[:, [0, -1]] = 0.4
    assert np.allclose(at(specs[3]), b)
    assert np.allclose(at(specs[5]), np.kron(g.reshape(4, 2, 4, 2).mean((1, 3)), np.ones((2, 2))))
    assert np.allclose(at(specs[6]), 1.2 * (g.mean() + 1.1 * (g - g.mean())))
    for bad in (lambda: T.crop(), lambda: T.crop((2, 0, 0, 0)), lambda: T.rescale(), lambda: T.flip("up"), lambda: T.blend("x"), lambda: T.composite("middle")):
        with pytest.raises(ValueError):
            bad()


def test_null_images_have_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None] * 64), (4, [0.5] * 64)], "file_id long, px array<double>")
    assert {r.file_id for r in T.variants(df, [T.flip()]).collect()} == {4}


def test_hashes(spark, grids):
    x, make = grids
    got = {(r.file_id, r.algo): np.array(r.hash) for r in H.hash_variants(T.variants(make(x), []), list(H.ALGORITHMS)).collect()}
    for i, row in enumerate(x):
        g = row.reshape(8, 8)
        assert (got[i, "sign"] == (row >= 0)).all() and (got[i, "average"] == (row > row.mean())).all()
        assert (got[i, "dhash"] == (np.roll(g, -1, 1) > g).ravel()).all() and (got[i, "dhash_vertical"] == (np.roll(g, -1, 0) > g).ravel()).all()
        c = np.array(H.cosine_matrix()) @ row
        assert (got[i, "phash"] == (c > np.median(c))).all() and (got[i, "wave"] == (row > np.median(row))).all()


def test_bad_files(spark, grids):
    x, make = grids
    rows = np.vstack([x[:2], -np.ones((1, 64))])
    h = H.hash_variants(T.variants(make(rows), [T.flip()]), ["sign", "average"])
    assert {r.file_id for r in H.drop_bad_files(h).select("file_id").distinct().collect()} == {0, 1}
    assert {r.algo: r.bad_files for r in H.bad_file_counts(h).collect()} == {"sign": 1, "average": 1}


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "sub").mkdir()
    pics = {f"p{i}.png": rng.integers(0, 256, (20 + i, 33, 3)) for i in range(3)}
    for n, p in pics.items():
        png(tmp_path / "sub" / n, p)
    (tmp_path / "bad.png").write_bytes(b"\x89PNG broken")
    scan = I.scan_images(spark, str(tmp_path), "*.png")
    h = I.hash_images(scan, list(I.IMAGE_ALGORITHMS), {"flip": I.flip_image(), "crop": I.crop_image(0.1, 0.1, 0.1, 0.1), "rot": I.rotate_image(5), "e": I.enhance_image(1.1, 1.2, 0.9, 1.5), "b": I.border_image(2), "r": I.rescale_image(0.5)})
    rows = {(r.filename, r.transform, r.algo): np.array(r.hash) for r in h.collect()}
    assert len(rows) == 3 * 7 * 7 and {k[0] for k in rows} == set(pics)
    for n, p in pics.items():
        for a, (f, size) in I.IMAGE_ALGORITHMS.items():
            assert len(rows[n, "orig", a]) == size and (rows[n, "orig", a] == f(p.astype(float))).all()
    assert I.list_files(spark, str(tmp_path)).count() == 4
    assert np.allclose(I.resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])


def test_tables(spark, grids, tmp_path):
    x, make = grids
    h = H.hash_variants(T.variants(make(x), []), ["sign"])
    tables.write_hash_csv(h, str(tmp_path / "csv"))
    back = {r.file_id: (r.hash, r.packed) for r in tables.read_hash_csv(spark, str(tmp_path / "csv")).collect()}
    assert back == {r.file_id: (r.hash, r.packed) for r in h.collect()}
    tables.write_table(h, str(tmp_path / "pq"), ("algo",))
    assert tables.read_parquet(spark, str(tmp_path / "pq")).count() == 5
    (tmp_path / "list.txt").write_text("a\nb\n\n")
    files = spark.createDataFrame([("a",), ("c",)], "filename string")
    assert [r.filename for r in tables.only_listed(files, spark, str(tmp_path / "list.txt")).collect()] == ["a"]
    assert tables.file_batches(files, 1).select("batch").distinct().count() <= 2
    p = tables.random_hash_pairs(spark, 50, 100).collect()
    assert len(p) == 50 and all(any(r.u) and len(r.u) == 2 for r in p)


def test_streaming(spark, tmp_path):
    from bitloom.streaming.ingest import match_known, stream_hashes, stream_vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 64))
    y = x.copy()
    y[:, :2] *= -1
    schema = "vec_id long, embedding array<float>, label int"
    known = stream_hashes(spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], schema))
    spark.createDataFrame([(10 + i, [float(v) for v in r], 0) for i, r in enumerate(y)], schema).write.parquet(str(tmp_path / "in"))
    q = match_known(stream_hashes(stream_vectors(spark, str(tmp_path / "in"))), known).writeStream.format("memory").queryName("matches").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.file_id, r.known_id, r.distance) for r in spark.table("matches").collect()} == {(10 + i, i, 2) for i in range(4)}

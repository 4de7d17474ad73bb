"""Image files: scan, decode, and the hashes that need pixels or colours.

Spark's image source decodes on the JVM (one row a file; a corrupt file has height -1). The
numerical work on pixels of any size is one mapInPandas with numpy: grey values are averaged
over blocks to the size that an algorithm asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.functions import bits as B
from bitloom.session import ship
from bitloom.sources.tables import basename

Pixels = np.ndarray  # height x width x 3, 0 to 255


def scan_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(filename, origin, width, height, channels, mode, data) of all image files under path; undecodable ones are dropped."""
    r = spark.read.format("image").option("recursiveFileLookup", True)
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    df = df.select(basename(F.col("image.origin")).alias("filename"), "image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")
    return df.where("height > 0")


def scan_variant(spark: SparkSession, path: str, name: str = "") -> tuple[str, DataFrame]:
    """(name, images) of a folder that holds ready-made variants under the original file names; the name is the folder's if none is given.

    Hash them as images and join by operators.transforms.with_disk_variants. A missing folder is an error.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        raise FileNotFoundError(path)
    return name or folder.getName(), scan_images(spark, path)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(filename, path, length) of all files under path, without reading them."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select(basename(F.col("path")).alias("filename"), "path", "length")


def decode(data: bytes, height: int, width: int, channels: int) -> Pixels:
    """Spark keeps BGR(A) or grey bytes."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(x, 3, 2) if channels == 1 else x[:, :, 2::-1]


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box resampling: the mean of the source area of each cell, by exact area weights."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = np.arange(n)[None, :], np.arange(n)[None, :] + 1
        w = np.clip(np.minimum(hi, edges[1:, None]) - np.maximum(lo, edges[:-1, None]), 0, None)
        return w / w.sum(1, keepdims=True)

    return np.tensordot(weights(x.shape[0], height), np.tensordot(weights(x.shape[1], width), x, (1, 1)), (1, 1))


def grey(x: Pixels) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114])


def _dct(n: int, rows: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def average_hash(x: Pixels, size: int = 8) -> np.ndarray:
    g = resize(grey(x), size, size)
    return (g > g.mean()).ravel()


def difference_hash(x: Pixels, size: int = 8, vertical: bool = False) -> np.ndarray:
    g = resize(grey(x), size + vertical, size + (not vertical))
    return (np.diff(g, axis=0 if vertical else 1) > 0).ravel()


def perceptual_hash(x: Pixels, size: int = 8, factor: int = 4) -> np.ndarray:
    n = size * factor
    d = _dct(n, size)
    c = np.round(d @ resize(grey(x), n, n) @ d.T, 6)
    return (c > np.median(c)).ravel()


def wavelet_hash(x: Pixels, size: int = 8) -> np.ndarray:
    """Haar approximation at size x size: block means of the largest power-of-two square, without the overall mean."""
    n = max(size, 1 << int(np.log2(min(x.shape[:2]))) if min(x.shape[:2]) >= size else size)
    g = resize(grey(x) / 255, n, n).reshape(size, n // size, size, n // size).mean((1, 3))
    g = np.round(g - g.mean(), 9)
    return (g > np.median(g)).ravel()


def colour_hash(x: Pixels, bits: int = 3) -> np.ndarray:
    """Shares of black, grey, and six hues of faint and of bright colours, each as a number of bits."""
    rgb = x / 255
    high, low = rgb.max(2), rgb.min(2)
    span = high - low
    sat = np.where(high > 0, span / np.where(high > 0, high, 1), 0) * 255
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    safe = np.where(span > 0, span, 1)
    hue = np.where(span == 0, 0, np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))) / 6 * 255
    black = grey(x) < 256 // 8
    plain = ~black & (sat < 256 // 3)
    bright = ~black & ~plain & (sat > 256 * 2 // 3)
    faint = ~black & ~plain & ~bright
    n = black.size
    coloured = max(1, int((~black & ~plain).sum()))
    shares = [black.sum() / n, plain[~black].mean() if (~black).any() else 0.0]
    for part in (faint, bright):
        shares += list(np.histogram(hue[part], 6, (0, 255))[0] / coloured)
    top = 1 << bits
    out = [min(top - 1, int(s * top)) for s in shares]
    return np.array([v >> (bits - 1 - i) & 1 for v in out for i in range(bits)], bool)


def pdq_hash(x: Pixels) -> np.ndarray:
    """256 bits: two passes of a box filter, 64 x 64 grey values, 16 x 16 cosine coefficients without the first row and column, > median."""
    g = grey(x)
    for _ in range(2):
        for axis in (0, 1):
            w = max(1, -(-g.shape[axis] // 128))
            pad = [(0, 0), (0, 0)]
            pad[axis] = (w // 2, w - 1 - w // 2)
            s = np.cumsum(np.pad(g, pad, mode="edge"), axis)
            s = np.insert(s, 0, 0, axis)
            g = (np.take(s, range(w, s.shape[axis]), axis) - np.take(s, range(s.shape[axis] - w), axis)) / w
    d = _dct(64, 17)[1:]
    c = np.round(d @ resize(g, 64, 64) @ d.T, 6)
    return (c > np.median(c)).ravel()


IMAGE_ALGORITHMS: dict[str, tuple[Callable[[Pixels], np.ndarray], int]] = {
    "average": (average_hash, 64), "dhash": (difference_hash, 64), "dhash_vertical": (lambda x: difference_hash(x, vertical=True), 64),
    "phash": (perceptual_hash, 64), "wave": (wavelet_hash, 64), "colour": (colour_hash, 42), "pdq": (pdq_hash, 256),
}

ImageTransform = Callable[[Pixels], Pixels]


def flip_image(direction: str = "horizontal") -> ImageTransform:
    return lambda x: x[:, ::-1] if direction.lower() == "horizontal" else x[::-1]


def crop_image(left: float, up: float, right: float, low: float) -> ImageTransform:
    return lambda x: x[int(x.shape[0] * up) : int(x.shape[0] * (1 - low)), int(x.shape[1] * left) : int(x.shape[1] * (1 - right))]


def border_image(width: int = 10, colour: Sequence[float] = (255, 255, 255)) -> ImageTransform:
    def run(x: Pixels) -> Pixels:
        y = np.empty_like(x)
        y[:] = np.asarray(colour, float)
        if min(x.shape[:2]) > 2 * width:
            y[width:-width, width:-width] = x[width:-width, width:-width]
        return y
    return run


def rescale_image(factor: float | None = None, fixed: tuple[int, int] | None = None, thumbnail: bool = True) -> ImageTransform:
    """By a factor, or to fixed (height, width); a thumbnail keeps the aspect within them and is never larger than the image."""
    if (factor is None) == (fixed is None):
        raise ValueError("give factor or fixed")

    def run(x: Pixels) -> Pixels:
        h, w = x.shape[:2]
        if factor is not None:
            return resize(x, max(1, int(h * factor)), max(1, int(w * factor)))
        if not thumbnail:
            return resize(x, *fixed)
        f = min(1.0, fixed[0] / h, fixed[1] / w)
        return resize(x, max(1, round(h * f)), max(1, round(w * f)))
    return run


def blend_image(static: Pixels, direction: str = "Left-to-Right") -> ImageTransform:
    """The image over a static one of its size, by a ramp of 256 steps; where the ramp is full, the image stays."""
    way = direction.lower()
    if way not in ("left-to-right", "right-to-left", "up-to-down", "down-to-up"):
        raise ValueError(f"unknown direction {direction}")

    def run(x: Pixels) -> Pixels:
        h, w = x.shape[:2]
        n = w if "left" in way else h
        ramp = np.floor(np.arange(n) / n * 255)
        ramp = (255 - ramp if way in ("right-to-left", "down-to-up") else ramp) / 255
        alpha = (ramp[None, :] if "left" in way else ramp[:, None])[..., None]
        return alpha * x + (1 - alpha) * resize(static, h, w)
    return run


def _pasted(x: Pixels, patch: Pixels, top: int, left: int, alpha: np.ndarray | float = 1.0) -> Pixels:
    """x with what of patch lies inside at (top, left)."""
    y = x.copy()
    a, b = max(top, 0), max(left, 0)
    c, d = min(top + patch.shape[0], x.shape[0]), min(left + patch.shape[1], x.shape[1])
    if a < c and b < d:
        cut = (slice(a - top, c - top), slice(b - left, d - left))
        own = alpha[cut] if isinstance(alpha, np.ndarray) else alpha
        y[a:c, b:d] = own * patch[cut] + (1 - own) * y[a:c, b:d]
    return y


def composite_image(static: Pixels, position: str = "left", coords: tuple[int, int] | None = None, scale: bool = False, size: tuple[int, int] | None = None) -> ImageTransform:
    """A static image pasted at a named position, or with its corner at coords (x, y).

    It is scaled to half of the image (sides) or a quarter (corners) if scale, to size
    (height, width) if that is given, else to all of the image.
    """
    if coords is None and position not in ("left", "right", "top", "bottom", "topleft", "topright", "bottomleft", "bottomright"):
        raise ValueError(f"unknown position {position}")

    def run(x: Pixels) -> Pixels:
        h, w = x.shape[:2]
        ph, pw = size or ((h if position in ("left", "right") else h // 2, w if position in ("top", "bottom") else w // 2) if scale else (h, w))
        left, top = coords if coords is not None else (w - pw if "right" in position else 0, h - ph if "bottom" in position else 0)
        return _pasted(x, resize(static, max(1, ph), max(1, pw)), top, left)
    return run


def watermark_image(mark: np.ndarray, height_factor: float = 0.1, min_height: int = 40) -> ImageTransform:
    """A mark (height x width x 4, its own alpha last) in the lower right corner, height_factor of the height but min_height at least, no wider than the image."""
    def run(x: Pixels) -> Pixels:
        h, w = x.shape[:2]
        mh = max(min_height, int(h * height_factor))
        mw = min(w, max(1, int(mark.shape[1] * mh / mark.shape[0])))
        m = resize(mark.astype(float), mh, mw)
        return _pasted(x, m[..., :3], h - mh, w - mw, m[..., 3:] / 255)
    return run


def rotate_image(degrees: float) -> ImageTransform:
    """Counter-clockwise, same canvas, nearest pixel, black outside."""
    def run(x: Pixels) -> Pixels:
        h, w = x.shape[:2]
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        dy, dx = np.mgrid[:h, :w].astype(float)
        dy, dx = dy - (h - 1) / 2, dx - (w - 1) / 2
        sy, sx = np.floor(s * dx + c * dy + h / 2 + 1e-9).astype(int), np.floor(c * dx - s * dy + w / 2 + 1e-9).astype(int)
        ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        return np.where(ok[..., None], x[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0.0)
    return run


def enhance_image(brightness: float = 1.0, colour: float = 1.0, contrast: float = 1.0, sharpness: float = 1.0) -> ImageTransform:
    """Colour, contrast, brightness, sharpness, in this order; 1 changes nothing."""
    def run(x: Pixels) -> Pixels:
        clip = lambda y: np.clip(y, 0, 255)
        g = grey(x)[..., None]
        x = clip(g + colour * (x - g))
        m = grey(x).mean()
        x = clip(clip(m + contrast * (x - m)) * brightness)
        if sharpness != 1.0:
            p = np.pad(x, ((1, 1), (1, 1), (0, 0)), mode="edge")
            near = sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3))
            x = clip(sharpness * x + (1 - sharpness) * (near + 4 * x) / 13)
        return x
    return run


def hash_images(images: DataFrame, algorithms: Sequence[str], transforms: dict[str, ImageTransform] | None = None) -> DataFrame:
    """Long hashes (filename, transform, algo, hash, packed) of scan_images: the original and each transform.

    A file of which any step fails has no rows at all.
    """
    ship(images.sparkSession)
    steps = {"orig": lambda x: x, **(transforms or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, h, w, c, data in zip(f["filename"], f["height"], f["width"], f["channels"], f["data"]):
                try:
                    x = decode(data, h, w, c)
                    out += [(name, t, a, IMAGE_ALGORITHMS[a][0](y).tolist()) for t, step in steps.items() for y in (step(x),) for a in algorithms]
                except (ValueError, IndexError, ZeroDivisionError):
                    continue
            yield pd.DataFrame(out, columns=["filename", "transform", "algo", "hash"])

    h = images.select("filename", "height", "width", "channels", "data").mapInPandas(run, "filename string, transform string, algo string, hash array<boolean>")
    packed = F.lit(None).cast("array<long>")
    for n in sorted({IMAGE_ALGORITHMS[a][1] for a in algorithms}):
        packed = F.when(F.size("hash") == n, B.pack(F.col("hash"), n)).otherwise(packed)
    return h.withColumn("packed", packed)

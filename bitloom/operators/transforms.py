"""Image transforms on a grid of cells, as one affine gather each.

Every geometric transform is a literal gather map (out[i] = src[map[i]], -1 for fill) and
every photometric one a per-cell affine map, so a variant is out[i] = a[i] * src[map[i]] +
b[i] (+ m[i] * mean). Variants are rows: the transform is a column of data, which keeps the
later pair join an equi join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

SIDE = 8
ORIG = "orig"


@dataclass(frozen=True)
class Affine:
    """out[i] = scale[i] * (mean of src over sources[i]; 0 if none) + offset[i] + mean_share[i] * mean(src)."""

    name: str
    sources: tuple[tuple[int, ...], ...]
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    mean_share: tuple[float, ...] = field(default=())

    def column(self, px: Column) -> Column:
        mean = F.aggregate(px, F.lit(0.0), lambda s, x: s + x) / float(len(self.scale))
        cells = []
        for i, src in enumerate(self.sources):
            x = F.lit(0.0)
            if src:
                x = F.get(px, F.lit(src[0]))
                for j in src[1:]:
                    x = x + F.get(px, F.lit(j))
                x = x / float(len(src)) if len(src) > 1 else x
            y = x * self.scale[i] + self.offset[i] if self.scale[i] != 1.0 or self.offset[i] else x
            cells.append(y + mean * self.mean_share[i] if self.mean_share and self.mean_share[i] else y)
        return F.array(*cells)


def _make(name: str, side: int, source: Callable[[int, int], tuple[int, int] | None], scale: Callable[[int, int], float] = lambda y, x: 1.0, offset: Callable[[int, int], float] = lambda y, x: 0.0) -> Affine:
    cells = [(y, x) for y in range(side) for x in range(side)]
    src = []
    for y, x in cells:
        p = source(y, x)
        src.append((p[0] * side + p[1],) if p is not None and 0 <= p[0] < side and 0 <= p[1] < side else ())
    return Affine(name, tuple(src), tuple(float(scale(*c)) for c in cells), tuple(float(offset(*c)) for c in cells))


def identity(side: int = SIDE) -> Affine:
    return _make(ORIG, side, lambda y, x: (y, x))


def flip(direction: str = "horizontal", side: int = SIDE) -> Affine:
    if direction.lower() not in ("horizontal", "vertical"):
        raise ValueError(f"unknown direction {direction}")
    h = direction.lower() == "horizontal"
    return _make(f"Flip_{direction}", side, lambda y, x: (y, side - 1 - x) if h else (side - 1 - y, x))


def rotate(degrees: float = 5, side: int = SIDE) -> Affine:
    """Counter-clockwise on the same canvas, nearest cell, 0 outside."""
    c, s, m = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (side - 1) / 2

    def source(y: int, x: int) -> tuple[int, int]:
        dy, dx = y - m, x - m
        return math.floor(s * dx + c * dy + m + 0.5 + 1e-9), math.floor(c * dx - s * dy + m + 0.5 + 1e-9)

    return _make(f"Rotate_{degrees:g}", side, source)


def border(width: int = 1, colour: float = 0.4, fraction: float = 0.0, side: int = SIDE) -> Affine:
    """An outline inside the image; fraction, a share of the side, replaces width if it is given."""
    w = max(1, round(fraction * side)) if fraction else width
    edge = lambda y, x: min(y, x, side - 1 - y, side - 1 - x) < w
    return _make(f"Border_bw{w}", side, lambda y, x: (y, x), lambda y, x: 0.0 if edge(y, x) else 1.0, lambda y, x: colour if edge(y, x) else 0.0)


def crop(factors: Sequence[float] = (), absolute: Sequence[int] = (), side: int = SIDE) -> Affine:
    """Left, upper, right, lower: shares of the side to cut, or a box of cells; the rest is stretched over the grid (nearest)."""
    if bool(factors) == bool(absolute):
        raise ValueError("give factors or absolute")
    if factors and not all(0 <= f <= 1 for f in factors):
        raise ValueError("factors must be in [0, 1]")
    box = tuple(absolute) if absolute else (int(side * factors[0]), int(side * factors[1]), int(side * (1 - factors[2])), int(side * (1 - factors[3])))
    left, up, right, low = box
    if not (0 <= left < right <= side and 0 <= up < low <= side):
        raise ValueError(f"empty box {box}")
    at = lambda i, a, b: a + min(int((i + 0.5) * (b - a) / side), b - a - 1)
    return _make("Crop_" + "_".join(f"{f:g}" for f in (factors or absolute)), side, lambda y, x: (at(y, up, low), at(x, left, right)))


def rescale(factor: float | None = None, fixed: tuple[int, int] | None = None, side: int = SIDE) -> Affine:
    """Down to a coarser grid by block means and back up; a finer or equal one changes nothing."""
    if (factor is None) == (fixed is None):
        raise ValueError("give factor or fixed")
    h, w = (int(side * factor),) * 2 if factor is not None else fixed
    h, w = min(max(h, 1), side), min(max(w, 1), side)
    span = lambda i, n: range(i * side // n, (i + 1) * side // n)
    src = tuple(tuple(b * side + a for b in span(y * h // side, h) for a in span(x * w // side, w)) for y in range(side) for x in range(side))
    n = side * side
    return Affine(f"Rescale_{h}x{w}", src, (1.0,) * n, (0.0,) * n)


def enhance(brightness: float = 1.0, contrast: float = 1.0, sharpness: float = 1.0, colour: float = 1.0, side: int = SIDE) -> Affine:
    """Contrast about the mean, then brightness. Colour has no effect on grey cells; sharpness needs neighbours and is for images."""
    if sharpness != 1.0:
        raise ValueError("sharpness is not affine in a cell; use the image source")
    n = side * side
    return Affine(f"Enhance_b{brightness:g}_c{contrast:g}", tuple((i,) for i in range(n)), (brightness * contrast,) * n, (0.0,) * n, (brightness * (1 - contrast),) * n)


def blend(direction: str = "Left-to-Right", static: Sequence[float] | float = 0.5, side: int = SIDE) -> Affine:
    """Composite with a static image by a ramp; where it is full, the source stays."""
    ways = {"left-to-right": lambda y, x: x, "right-to-left": lambda y, x: side - x, "up-to-down": lambda y, x: y, "down-to-up": lambda y, x: side - y}
    if direction.lower() not in ways:
        raise ValueError(f"unknown direction {direction}")
    alpha = lambda y, x: int(ways[direction.lower()](y, x) / side * 255) / 255
    cell = lambda y, x: static if isinstance(static, int | float) else static[y * side + x]
    return _make(f"Blend_{direction}", side, lambda y, x: (y, x), alpha, lambda y, x: (1 - alpha(y, x)) * cell(y, x))


POSITIONS = ("left", "right", "top", "bottom", "topleft", "topright", "bottomleft", "bottomright")


def composite(position: str = "left", coords: tuple[int, int] | None = None, size: tuple[int, int] | None = None, static: float = 0.5, scale: bool = True, side: int = SIDE) -> Affine:
    """Paste a static patch of size (height, width) at a named position, or with its corner at coords (x, y).

    Without a size it is half the grid (a quarter in corners) if scale, else all of it.
    """
    if coords is None and position not in POSITIONS:
        raise ValueError(f"unknown position {position}")
    half = side // 2 if scale else side
    h, w = size or (half if position not in ("left", "right") else side, half if position not in ("top", "bottom") else side)
    x0, y0 = coords if coords is not None else (side - w if "right" in position else 0, side - h if "bottom" in position else 0)
    inside = lambda y, x: y0 <= y < y0 + h and x0 <= x < x0 + w
    return _make(f"Composite_{position if coords is None else f'{x0}_{y0}'}", side, lambda y, x: (y, x), lambda y, x: 0.0 if inside(y, x) else 1.0, lambda y, x: static if inside(y, x) else 0.0)


def watermark(size: int = 2, alpha: float = 0.5, value: float = 0.5, side: int = SIDE) -> Affine:
    """A square with its own alpha in the lower right corner."""
    inside = lambda y, x: y >= side - size and x >= side - size
    return _make("Watermark", side, lambda y, x: (y, x), lambda y, x: 1 - alpha if inside(y, x) else 1.0, lambda y, x: alpha * value if inside(y, x) else 0.0)


TRANSFORMS: dict[str, Callable[..., Affine]] = {
    "Blend": blend, "Border": border, "Composite": composite, "Crop": crop, "Enhance": enhance, "Flip": flip, "Rescale": rescale, "Rotate": rotate, "Watermark": watermark,
}


def register_transform(name: str, function: Callable[..., Affine]) -> None:
    TRANSFORMS[name] = function


def list_transforms() -> list[str]:
    return sorted([*TRANSFORMS, "TransformFromDisk"])


def variants(images: DataFrame, transforms: Sequence[Affine]) -> DataFrame:
    """(file_id, transform, px) with the original first: one row for each image and transform.

    images has file_id and px (array<double>). An image with a null or short px has none of
    its variants (all or nothing for a file).
    """
    side2 = len(transforms[0].scale) if transforms else SIDE * SIDE
    ok = F.coalesce((F.size("px") == side2) & ~F.exists("px", lambda x: x.isNull()), F.lit(False))
    rows = [F.struct(F.lit(ORIG).alias("transform"), F.col("px").alias("px"))]
    rows += [F.struct(F.lit(t.name).alias("transform"), t.column(F.col("px")).alias("px")) for t in transforms]
    return images.where(ok).select("file_id", F.explode(F.array(*rows)).alias("v")).select("file_id", "v.transform", "v.px")


def with_disk_variants(hashes: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Rows of another scan as the transform name, for files that both have; both have filename, algo and hash."""
    files = hashes.select("filename").distinct()
    extra = other.where(F.col("transform") == ORIG).join(files, "filename", "left_semi").withColumn("transform", F.lit(name))
    return hashes.unionByName(extra)

"""Measures and features of decoded images, as Arrow batch functions over (id, width, height, pixels).

``pixels`` holds width * height RGB bytes, row by row. Decoding encoded files is outside the engine; what is measured
here is what SQL can't express: transforms and neighbourhoods of pixel arrays. Everything runs on numpy over one image
at a time inside Arrow batches, so memory is bounded by a batch.

Odd input: null pixels, or a byte count that doesn't match the size, give nulls; images smaller than three pixels a side
have no neighbourhood measures (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

# The layout and constants of the feature vector.
HSV_BINS, LAB_BINS = 24, 16
HSV_POINTS = (0.10, 0.90)
LBP_POINTS, LBP_RADIUS = 16, 2
HOG = {"directions": 9, "cell": 16, "block": 2}
MASK = {"saturation": 0.12, "grey": 0.86, "rim": 2, "least": 0.01, "most": 0.98, "radius": 0.43}
SIDE, PAD = 224, 255
# Rows of features that a Python worker gives back at once.
BATCH = 128
# sRGB to XYZ for the D65 white point, and that white point.
RGB_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
# The CIE constants epsilon and kappa.
CIE_EPSILON, CIE_KAPPA = 216 / 24389, 24389 / 27


def as_array(width: int | None, height: int | None, pixels: bytes | None) -> np.ndarray | None:
    if pixels is None or not width or not height or len(pixels) != 3 * width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width), 3)


def luma(rgb: np.ndarray) -> np.ndarray:
    # one order of bytes: it decides how a half is rounded
    return np.rint(rgb.astype(np.float64, order="C") @ np.array([0.299, 0.587, 0.114]))


def dct_bits(gray32: np.ndarray) -> int:
    """63 bits of a 32 x 32 grey matrix: the low 8 x 8 cosine coefficients without the first, against their median."""
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / 64) / 4.0
    basis[0] /= np.sqrt(2)
    low = np.round(basis @ gray32.astype(np.float64) @ basis.T, 6).ravel()[1:]
    return int("".join("1" if b else "0" for b in low > np.median(low)), 2)


def shrink(gray: np.ndarray, side: int = 32) -> np.ndarray:
    """Area means on a ``side`` x ``side`` grid."""
    h, w = gray.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = gray.cumsum(0).cumsum(1)
    ys = np.linspace(0, h, side + 1).round().astype(int)
    xs = np.linspace(0, w, side + 1).round().astype(int)
    y0, y1 = np.minimum(ys[:-1], h - 1), np.maximum(ys[1:], np.minimum(ys[:-1], h - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], w - 1), np.maximum(xs[1:], np.minimum(xs[:-1], w - 1) + 1)
    box = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return box / np.outer(y1 - y0, x1 - x0)


def laplacian_variance(gray: np.ndarray, border: str) -> float:
    """Population variance of the four-neighbour Laplacian; borders mirrored (``reflect``) or wrapped (``wrap``)."""
    p = np.pad(gray, 1, mode=border)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def gradient_strength(gray: np.ndarray) -> np.ndarray:
    """Magnitude of wrapped central differences."""
    p = np.pad(gray, 1, mode="wrap")
    return np.hypot(p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]) / 2.0


def _hsv(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value of the planes of red, green and blue."""
    r, g, b = planes.astype(np.float64) / 255.0
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    red, green = r == top, g == top
    third = np.where(red, g - b, np.where(green, b - r, r - g)) / np.where(span > 1e-8, span, 1) + np.where(red, 0, np.where(green, 2, 4))
    hue = np.where(span > 1e-8, np.where(third < 0, third + 6, third) / 6, 0.0)
    return hue, np.where(top > 1e-8, span / np.where(top > 1e-8, top, 1), 0.0), top


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    return np.stack(_hsv(np.moveaxis(rgb, -1, 0)), -1)


def _srgb_levels() -> np.ndarray:
    """Linear light of the 256 levels of a channel (IEC 61966-2-1)."""
    level = np.linspace(0.0, 1.0, 256)
    straight = level / 12.92
    return np.where(level > 0.04045, np.power((level + 0.055) / 1.055, 2.4), straight)


LINEAR = _srgb_levels()


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE 1976 L*a*b*, with the cube root continued linearly below epsilon."""
    return np.stack(_lab(np.moveaxis(rgb, -1, 0)), -1)


def _lab(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    relative = np.tensordot(RGB_XYZ / WHITE[:, None], LINEAR[planes], axes=1)
    x, y, z = np.where(relative > CIE_EPSILON, np.cbrt(relative), (CIE_KAPPA * relative + 16) / 116)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def _bins(share: np.ndarray, bins: int) -> np.ndarray:
    """The one of ``bins`` equal bins on [0, 1] that each share falls into."""
    return np.minimum((share * bins).astype(np.uint16), bins - 1)


class Lookup:
    """What one task keeps between pictures: facts of the colours met so far, and resampling weights of some sizes.

    A colour is worked out once, when it is first met: its hue and its place in the joint Lab histogram. Memory is touched
    only where colours are met, 10 bytes for each of at most 2^24.
    """

    MET, SIZES, ROWS = 1 << 15, 32, 32

    def __init__(self) -> None:
        self.hue, self.lab = np.zeros(1 << 24), np.zeros(1 << 24, np.uint16)
        self.weights: dict[tuple[int, int], list[tuple[slice, slice, np.ndarray]]] = {}

    def _meet(self, keys: np.ndarray) -> None:
        for k in range(0, len(keys), 1 << 16):
            new = keys[k : k + (1 << 16)]
            new = new[self.lab[new] < self.MET]
            number = np.arange(len(new), dtype=np.uint16)
            self.lab[new] = number
            new = new[self.lab[new] == number]  # one of each
            for part in np.array_split(new, len(new) // 8192 + 1):
                planes = np.stack([part & 255, part >> 8 & 255, part >> 16]).astype(np.uint8)
                light, a, b = _lab(planes)
                light, a, b = (_bins(x.clip(0, 1), LAB_BINS) for x in (light / 100, (a + 128) / 255, (b + 128) / 255))
                self.hue[part], self.lab[part] = _hsv(planes)[0], (light * LAB_BINS + a) * LAB_BINS + b | self.MET

    def colours(self, rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pixel, its hue and its place in a histogram of LAB_BINS^3 bins."""
        r, g, b = (rgb[..., c].ravel().astype(np.uint32) for c in range(3))
        keys = (r | g << 8 | b << 16).astype(np.intp)
        place = self.lab.take(keys)
        new = place < self.MET
        if new.any():
            self._meet(keys[new])
            place = self.lab.take(keys)
        return self.hue.take(keys), place ^ self.MET

    def resampling(self, old: int, new: int) -> list[tuple[slice, slice, np.ndarray]]:
        """``_resampling`` in blocks of rows, each with the columns it reads."""
        if (old, new) not in self.weights:
            if len(self.weights) >= self.SIZES:
                self.weights.clear()
            kernel, blocks = _resampling(old, new), []
            for k in range(0, new, self.ROWS):
                rows = slice(k, k + self.ROWS)
                used = np.flatnonzero(kernel[rows].any(0))
                columns = slice(used[0], used[-1] + 1)
                blocks.append((rows, columns, kernel[rows, columns].copy()))
            self.weights[old, new] = blocks
        return self.weights[old, new]


def _saturations() -> tuple[np.ndarray, np.ndarray]:
    """All saturations in order, and the number of the one of each greatest and least level (at 256 * greatest + least)."""
    top, low = np.divmod(np.arange(65536), 256)
    low = np.minimum(low, top)
    values, number = np.unique(_hsv(np.stack([top, low, low]))[1], return_inverse=True)
    return values, number.astype(np.uint16)


SATURATIONS, SATURATION_OF = _saturations()
VALUES = np.arange(256) / 255.0
# Least hue of each bin: bins are found by product, so that the next number up may be the first that reaches it.
_edges = np.arange(HSV_BINS) / HSV_BINS
HUE_EDGES = np.where((_edges * HSV_BINS).astype(int) < np.arange(HSV_BINS), np.nextafter(_edges, 1), _edges)


def _between(pick: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The percentiles HSV_POINTS of ``n`` values, of which ``pick`` gives those at the asked places in order."""
    at = np.array(HSV_POINTS) * (n - 1)
    low, high = pick(np.floor(at).astype(int)), pick(np.ceil(at).astype(int))
    return low + (high - low) * (at - np.floor(at))


def _of_counts(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Histogram and spread of sorted values from their counts."""
    n = counts.sum()
    mean = counts @ values / n
    upto = counts.cumsum()
    points = _between(lambda at: values[np.searchsorted(upto, at, "right")], n)
    return np.bincount(_bins(values, HSV_BINS), counts, HSV_BINS), [mean, np.sqrt(counts @ (values - mean) ** 2 / n), *points]


def _saturation_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest level of each pixel, and the number of its saturation."""
    top, low = (f(f(rgb[..., 0], rgb[..., 1]), rgb[..., 2]) for f in (np.maximum, np.minimum))
    return top, SATURATION_OF.take(top.astype(np.uint16) << 8 | low)


def colour(rgb: np.ndarray, lookup: Lookup | None = None) -> np.ndarray:
    """132 numbers: HSV and Lab histograms, then mean, deviation and two percentiles of each HSV channel."""
    hue, place = (lookup or Lookup()).colours(rgb)
    hue.sort()
    hues = np.diff(np.searchsorted(hue, HUE_EDGES), append=hue.size)
    spread = [hue.mean(), hue.std(), *_between(hue.__getitem__, hue.size)]
    top, number = _saturation_of(rgb)
    saturations, spread_s = _of_counts(SATURATIONS, np.bincount(number.ravel(), minlength=SATURATIONS.size))
    values, spread_v = _of_counts(VALUES, np.bincount(top.ravel(), minlength=256))
    lab = np.bincount(place, minlength=LAB_BINS**3).reshape((LAB_BINS,) * 3)
    counts = [hues, saturations, values, lab.sum((1, 2)), lab.sum((0, 2)), lab.sum((0, 1))]
    return np.concatenate([np.concatenate(counts) / hue.size, spread, spread_s, spread_v])


def _patterns() -> np.ndarray:
    """Bin of each ring of comparisons, a bit each: the set bits of a ring that flips at most twice, else the last bin."""
    ring = np.arange(1 << LBP_POINTS)
    flips = ring ^ (ring >> 1 | (ring & 1) << LBP_POINTS - 1)
    return np.where(np.bitwise_count(flips) <= 2, np.bitwise_count(ring), LBP_POINTS + 1).astype(np.uint8)


PATTERNS = _patterns()


def texture(gray: np.ndarray) -> np.ndarray:
    """21 numbers of a plane of whole levels: uniform local binary patterns (18 bins) and three edge statistics."""
    gray = gray.astype(np.uint8, copy=False)
    h, w = gray.shape
    far = np.pad(gray, LBP_RADIUS, mode="wrap")
    turn = 2 * np.pi * np.arange(LBP_POINTS) / LBP_POINTS
    at = [(LBP_RADIUS + int(round(LBP_RADIUS * np.sin(a))), LBP_RADIUS - int(round(LBP_RADIUS * np.cos(a)))) for a in turn]
    ring, half = np.zeros((2, h, w), np.uint8), LBP_POINTS // 2
    for k, (y, x) in enumerate(at):
        part = ring[k // half]
        np.add(part, part, out=part)
        np.bitwise_or(part, far[y : y + h, x : x + w] >= gray, out=part)
    pattern = np.bincount(PATTERNS.take(ring[0].astype(np.uint16) << half | ring[1]).ravel(), minlength=LBP_POINTS + 2)
    near = far[LBP_RADIUS - 1 : LBP_RADIUS + h + 1, LBP_RADIUS - 1 : LBP_RADIUS + w + 1].astype(np.int32)
    square = ((near[1:-1, 2:] - near[1:-1, :-2]) ** 2 + (near[2:, 1:-1] - near[:-2, 1:-1]) ** 2).ravel()
    # an edge is half the root of its square; a cut between two neighbours in order is reached by the upper one and its equals
    least = np.partition(square, k := -(-3 * (square.size - 1) // 4))[k]
    edges = np.sqrt(square) / 2
    return np.concatenate([pattern / pattern.sum(), [(square >= least).mean() if least > 0 else 0.0, edges.mean() / 255, edges.std() / 255]])


def foreground(rgb: np.ndarray, gray: np.ndarray | None = None) -> np.ndarray:
    """Mask of what is coloured or not bright, inside a rim; the central ellipse if that is nearly nothing or all."""
    inner = (slice(MASK["rim"], -MASK["rim"]),) * 2
    gray = luma(rgb) if gray is None else gray
    found = np.zeros(rgb.shape[:2], bool)
    found[inner] = (_saturation_of(rgb[inner])[1] >= np.searchsorted(SATURATIONS, MASK["saturation"], "right")) | (gray[inner] < MASK["grey"] * 255)
    if MASK["least"] <= found.mean() <= MASK["most"]:
        return found
    # offsets of pixel centres from the middle, as parts of the picture
    down, right = (np.linspace(-0.5, 0.5, n, endpoint=False) + 0.5 / n for n in found.shape)
    return np.add.outer(down**2, right**2) <= MASK["radius"] ** 2


def hu_invariants(mask: np.ndarray) -> np.ndarray:
    """Hu's seven invariants of a mask, from complex moments c(p, q) of its pixels (Flusser's formulation).

    With z the centred pixels as complex numbers, c(p, q) sums z^p times the conjugate of z^q; c(p, q) turns by the angle
    p - q, so products whose angles cancel are invariant.
    """
    power = lambda n: np.arange(n) ** np.arange(4.0)[:, None]
    raw = power(mask.shape[0]) @ mask.astype(float) @ power(mask.shape[1]).T
    # whole numbers, so that moments which cancel are nothing and not a rounding error
    n, x1, x2, x3, y1, xy, xxy, y2, xyy, y3 = (int(raw[q, p]) for q, p in ((0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)))
    xx, yy, both = n * x2 - x1 * x1, n * y2 - y1 * y1, n * xy - x1 * y1
    xxx, yyy = (n * n * c - 3 * n * a * b + 2 * a**3 for a, b, c in ((x1, x2, x3), (y1, y2, y3)))
    xx_y = n * n * xxy - 2 * n * x1 * xy - n * y1 * x2 + 2 * x1 * x1 * y1
    x_yy = n * n * xyy - 2 * n * y1 * xy - n * x1 * y2 + 2 * y1 * y1 * x1
    # parts of c(2, 0), c(3, 0) and c(1, 2), then of the square and cube of the last
    a, b = xx - yy, 2 * both
    c, d = xxx - 3 * x_yy, 3 * xx_y - yyy
    e, f = xxx + x_yy, -xx_y - yyy
    square, cube = (e * e - f * f, 2 * e * f), (e**3 - 3 * e * f * f, 3 * e * e * f - f**3)
    invariants = (xx + yy, 3), (a * a + b * b, 6), (c * c + d * d, 9), (e * e + f * f, 9), (c * cube[0] - d * cube[1], 18), (a * square[0] - b * square[1], 12), (c * cube[1] + d * cube[0], 18)
    return np.array([x / n**k for x, k in invariants])


def shape(rgb: np.ndarray, gray: np.ndarray | None = None) -> np.ndarray:
    """12 numbers: area, aspect, extent, boundary and roundness of the mask, and Hu's invariants as signed logarithms."""
    mask = foreground(rgb, gray)
    area = np.count_nonzero(mask)
    out = np.zeros(12)
    if not area:
        return out
    # height and width of the bounding box, from the projections on both axes
    tall, wide = (np.ptp(np.flatnonzero(mask.any(axis))) + 1 for axis in (1, 0))
    border = sum(np.count_nonzero(np.diff(mask, axis=axis)) for axis in (0, 1))
    out[:5] = area / mask.size, wide / tall, area / (wide * tall), border / (2 * sum(mask.shape)), 4 * np.pi * area / (border**2 + 1e-6)
    if area >= 5:
        hu = hu_invariants(mask)
        out[5:] = (-np.sign(hu) * np.log10(np.abs(hu) + 1e-30)).clip(-30, 30)
    return out


def _direction(down: np.ndarray, across: np.ndarray) -> np.ndarray:
    n = HOG["directions"]
    return ((np.floor(np.degrees(np.arctan2(down, across)) % 180 / (180 / n)).astype(int)) % n).astype(np.uint8)


# Direction bin of each pair of differences from -255 to 255, at 511 * (down + 255) + across + 255.
DIRECTIONS = _direction(np.arange(-255, 256)[:, None], np.arange(-255, 256)).ravel()


def oriented_gradients(gray: np.ndarray) -> np.ndarray:
    """Histogram of oriented gradients over cells of a plane of whole levels, clipped and renormalised by overlapping
    blocks. Sides must be multiples of the cell."""
    n, cell, block = HOG["directions"], HOG["cell"], HOG["block"]
    h, w = (s // cell for s in gray.shape)
    gray = gray.astype(np.int32)
    gy, gx = np.zeros_like(gray), np.zeros_like(gray)  # twice the differences: central ones, one-sided ones at the borders
    np.subtract(gray[2:], gray[:-2], out=gy[1:-1])
    np.subtract(gray[:, 2:], gray[:, :-2], out=gx[:, 1:-1])
    way = DIRECTIONS.take((gy + 255) * 511 + gx + 255)
    gy[0], gy[-1], gx[:, 0], gx[:, -1] = 2 * (gray[1] - gray[0]), 2 * (gray[-1] - gray[-2]), 2 * (gray[:, 1] - gray[:, 0]), 2 * (gray[:, -1] - gray[:, -2])
    for rim in np.s_[0, :], np.s_[-1, :], np.s_[:, 0], np.s_[:, -1]:
        way[rim] = _direction(gy[rim], gx[rim])
    place = np.add.outer(np.arange(gray.shape[0]) // cell * w, np.arange(gray.shape[1]) // cell)
    strength = np.sqrt(gx * gx + gy * gy) / 510
    cells = np.bincount((place * n + way).ravel(), strength.ravel(), h * w * n).reshape(h, w, n)
    blocks = np.lib.stride_tricks.sliding_window_view(cells, (block, block), (0, 1)).transpose(0, 1, 3, 4, 2).reshape(-1, block * block * n)
    unit = lambda b: b / np.sqrt((b * b).sum(1, keepdims=True) + 1e-6)
    return unit(np.minimum(unit(blocks), 0.2)).ravel()


def _resampling(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Matrix of ``new`` rows that resample ``old`` pixels with a Lanczos window, widened where the picture shrinks."""
    wide = max(old / new, 1.0)
    offset = (np.arange(old) + 0.5 - (np.arange(new)[:, None] + 0.5) * old / new) / wide
    kernel = np.where(np.abs(offset) < lobes, np.sinc(offset) * np.sinc(offset / lobes), 0.0)
    return kernel / kernel.sum(1, keepdims=True)


def letterbox(rgb: np.ndarray, side: int = SIDE, pad: int = PAD, lookup: Lookup | None = None) -> np.ndarray:
    """Fits an image into a square without stretching, by Lanczos resampling, padded evenly. The planes lie one by one."""
    lookup = lookup or Lookup()
    fit = side / max(rgb.shape[:2])
    h, w = (max(1, round(n * fit)) for n in rgb.shape[:2])
    rows = rgb.transpose(0, 2, 1).astype(np.float64).reshape(rgb.shape[0], -1)
    tall = np.empty((h, rows.shape[1]))
    for to, used, kernel in lookup.resampling(rgb.shape[0], h):
        np.matmul(kernel, rows[used], out=tall[to])
    tall = tall.reshape(h * 3, -1)
    picture = np.empty((h * 3, w))
    for to, used, kernel in lookup.resampling(rgb.shape[1], w):
        picture[:, to] = tall[:, used] @ kernel.T
    np.rint(picture, out=picture)
    np.maximum(picture, 0, out=picture)
    np.minimum(picture, 255, out=picture)
    out = np.full((3, side, side), pad, np.uint8)
    top, left = (side - h) // 2, (side - w) // 2
    out[:, top : top + h, left : left + w] = picture.reshape(h, 3, w).transpose(1, 0, 2)
    return out.transpose(1, 2, 0)


def equalise(light: np.ndarray, clip: float = 2.0, grid: int = 8, levels: int = 256) -> np.ndarray:
    """Contrast-limited adaptive equalisation (CLAHE) of a plane of whole levels.

    Each tile of a ``grid`` x ``grid`` raster has its histogram clipped at ``clip`` times the even height, the excess spread
    evenly, and the levels mapped by its cumulative curve; a pixel is mapped by the four nearest tiles, bilinearly.
    """
    h, w = light.shape
    th, tw = -(-h // grid), -(-w // grid)
    tiles = np.pad(light, ((0, th * grid - h), (0, tw * grid - w)), mode="symmetric").reshape(grid, th, grid, tw).transpose(0, 2, 1, 3).reshape(grid * grid, th * tw)
    counts = np.stack([np.bincount(t, minlength=levels) for t in tiles]).astype(float)
    limit = max(1.0, clip * th * tw / levels)
    excess = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    curve = ((np.minimum(counts, limit) + excess / levels).cumsum(1) * (levels - 1) / (th * tw)).reshape(grid, grid, levels)

    def near(n: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / step - 0.5
        low = np.floor(at).astype(int)
        return low.clip(0, grid - 1), (low + 1).clip(0, grid - 1), at - low

    y0, y1, fy = near(h, th)
    x0, x1, fx = near(w, tw)
    pick = lambda y, x: curve[y[:, None], x[None, :], light]
    upper = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    lower = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.rint(upper * (1 - fy[:, None]) + lower * fy[:, None]).clip(0, levels - 1).astype(np.uint8)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The inverse of ``to_lab``, as RGB bytes."""
    y = (lab[..., 0] + 16) / 116
    response = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    cubed = response**3
    xyz = np.where(cubed > CIE_EPSILON, cubed, (116 * response - 16) / CIE_KAPPA) * WHITE
    light = (xyz @ np.linalg.inv(RGB_XYZ).T).clip(0, 1)
    return np.rint(255 * np.where(light > 0.0031308, 1.055 * np.power(light, 1 / 2.4) - 0.055, 12.92 * light)).astype(np.uint8)


def local_contrast(rgb: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """CLAHE on the lightness alone; the hues stay."""
    lab = to_lab(rgb)
    lab[..., 0] = equalise(np.rint(lab[..., 0].clip(0, 100) * 2.55).astype(np.uint8), clip, grid) / 2.55
    return from_lab(lab)


def smooth(rgb: np.ndarray, width: int = 3) -> np.ndarray:
    """Gaussian filter of an odd width, separable, borders mirrored; the deviation follows the width."""
    if width < 1 or width % 2 == 0:
        raise ValueError("the width must be odd and positive")
    at = np.arange(width) - width // 2
    kernel = np.exp(-(at**2) / (2 * (0.3 * (width // 2 - 1) + 0.8) ** 2))
    kernel /= kernel.sum()
    out = rgb.astype(np.float64)
    for axis in (0, 1):
        pad = [(width // 2,) * 2 if a == axis else (0, 0) for a in range(3)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="reflect" if rgb.shape[axis] > width // 2 else "edge"), width, axis) @ kernel
    return np.rint(out).clip(0, 255).astype(np.uint8)


def feature_vector(rgb: np.ndarray, contrast: bool = False, width: int = 0, lookup: Lookup | None = None) -> np.ndarray:
    """Colour, texture, shape and gradients of the letterboxed image, in this order: 6249 numbers.

    ``contrast`` and a ``width`` apply local contrast and the Gaussian filter first. A ``lookup`` kept between images saves
    working out the same colours again.
    """
    lookup = lookup or Lookup()
    box = letterbox(rgb, lookup=lookup)
    box = local_contrast(box) if contrast else box
    box = smooth(box, width) if width else box
    gray = luma(box).astype(np.uint8)
    return np.concatenate([colour(box, lookup), texture(gray), shape(box, gray), oriented_gradients(gray)])


def measure(rgb: np.ndarray) -> dict:
    """All scalar measures under both border rules, fingerprint and content digest."""
    import hashlib

    gray = luma(rgb)
    small = min(gray.shape) < 3
    hsv = to_hsv(rgb)
    return {
        "brightness": float(gray.mean()),
        "saturation": float(hsv[..., 1].mean()),
        "blur_score": None if small else laplacian_variance(gray, "reflect"),
        "blur_wrapped": None if small else laplacian_variance(gray, "wrap"),
        "edge_strength": float(gradient_strength(gray).mean()),
        "phash63": dct_bits(shrink(gray)),
        "pixel_sha256": hashlib.sha256(f"RGB:{rgb.shape[1]}:{rgb.shape[0]}:".encode() + rgb.tobytes()).hexdigest(),
    }


MEASURES = "brightness double, saturation double, blur_score double, blur_wrapped double, edge_strength double, phash63 long, pixel_sha256 string"


def _map(images: DataFrame, make: Callable[[np.ndarray | None], dict], schema: str) -> DataFrame:
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for w, h, p in zip(x["width"], x["height"], x["pixels"], strict=True):
                found = make(None if pd.isna(w) or pd.isna(h) else as_array(int(w), int(h), p))
                rows.append([found.get(n) for n in names])
            out = pd.DataFrame(rows, columns=names, index=x.index).astype(object)
            yield pd.concat([x[["id"]], out.where(out.notna(), None)], axis=1)

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, {schema}")


def measure_images(images: DataFrame) -> DataFrame:
    return _map(images, lambda a: {} if a is None else measure(a), MEASURES)


def image_features(images: DataFrame, contrast: bool = False, width: int = 0, kind: str = "double", draw: Callable[[int], bytes] | None = None, side: int = 0) -> DataFrame:
    """(id, other columns, features) with 6249 numbers each, double or float, as ``feature_vector`` makes them.

    All columns but the picture's are passed through. With ``draw`` the rows hold no pictures: it gives the pixels of an
    id, ``side`` wide and high, in the worker that measures them (null without an id). A picture equal to the row before
    isn't worked out again, so rows that share one are best sorted by it.
    """
    keep = [c for c in images.columns if c not in ("width", "height", "pixels")]
    named = ["id"] if draw else ["width", "height", "pixels"]
    number = {"double": np.float64, "float": np.float32}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, before, vector = Lookup(), None, None
        for x in batches:
            for k in range(0, x.num_rows, BATCH):
                part = x.slice(k, BATCH)
                rows = []
                for picture in zip(*(part.column(c).to_pylist() for c in named), strict=True):
                    if picture != before:
                        before = picture
                        a = as_array(*picture) if not draw else None if picture[0] is None else as_array(side, side, draw(picture[0]))
                        vector = None if a is None else feature_vector(a, contrast, width, lookup)
                        if vector is not None and not np.isfinite(vector).all():
                            raise ValueError("a feature is not finite")
                    rows.append(vector)
                found = np.array([v is not None for v in rows], bool)
                flat = np.concatenate([np.empty(0), *(v for v in rows if v is not None)]).astype(number)
                ends = np.concatenate([[0], found.cumsum() * (flat.size // max(found.sum(), 1))]).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), features], [*keep, "features"])

    schema = StructType([images.schema[c] for c in keep]).add("features", ArrayType(DoubleType() if kind == "double" else FloatType()))
    return images.select(*keep, *(c for c in named if c not in keep)).mapInArrow(run, schema)


def synthetic(side: int = 48) -> Callable[[int], bytes]:
    """Draws the pixels of an id: a reproducible test picture, a shaded disc on a noisy ground, that depends on the id alone."""
    y, xx = np.mgrid[:side, :side]

    def draw(i: int) -> bytes:
        r = np.random.default_rng(i)
        ground = r.integers(150, 250, 3)
        fruit = r.integers(20, 230, 3)
        cy, cx, rad = r.uniform(0.35, 0.65) * side, r.uniform(0.35, 0.65) * side, r.uniform(0.15, 0.35) * side
        disc = ((y - cy) ** 2 + (xx - cx) ** 2 <= rad**2)[..., None]
        shade = 1 - 0.4 * (xx / side)[..., None]
        pic = np.where(disc, fruit * shade, ground) + r.normal(0, 6, (side, side, 3))
        return np.clip(pic, 0, 255).astype(np.uint8).tobytes()

    return draw


def synthetic_images(ids: DataFrame, side: int = 48) -> DataFrame:
    """(id, width, height, pixels): the ``synthetic`` picture of each id."""
    draw = synthetic(side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "width": side, "height": side, "pixels": [draw(int(i)) for i in x["id"]]})

    return ids.select(F.col("id").cast("long").alias("id")).mapInPandas(run, "id long, width int, height int, pixels binary")

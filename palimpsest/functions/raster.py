"""Raster kernels in NumPy: resampling, grey, gradient and cosine hashes.

A raster is height x width x 4 bytes, red, green, blue and alpha, not
premultiplied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

Shape = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Filter:
    """A resampling filter: kernel(|x|) within the support. Support 0 means the nearest pixel."""

    name: str
    support: float
    shape: Shape | None = None

    def kernel(self, x: np.ndarray | float) -> np.ndarray:
        x = np.abs(np.asarray(x, np.float64))
        if self.shape is None:
            return np.zeros_like(x)
        return np.where(x <= self.support if self.name == "box" else x < self.support, self.shape(x), 0.0)


def _sinc(x: np.ndarray) -> np.ndarray:
    safe = np.where(x == 0, 1.0, np.pi * x)
    return np.where(x == 0, 1.0, np.sin(safe) / safe)


def _cubic(b: float, c: float) -> Shape:
    """The two-parameter family of Mitchell and Netravali."""

    def f(x: np.ndarray) -> np.ndarray:
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
        return np.where(x < 1, near, ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6)

    return f


def _windowed(window: Shape) -> Shape:
    return lambda x: _sinc(x) * window(x)


FILTERS = {
    f.name: f
    for f in (
        Filter("nearest", 0.0),
        Filter("box", 0.5, np.ones_like),
        Filter("linear", 1.0, lambda x: 1.0 - x),
        Filter("hermite", 1.0, _cubic(0, 0)),
        Filter("mitchell", 2.0, _cubic(1 / 3, 1 / 3)),
        Filter("catmullrom", 2.0, _cubic(0, 0.5)),
        Filter("bspline", 2.0, _cubic(1, 0)),
        Filter("gaussian", 2.0, lambda x: np.exp(-2 * x * x)),
        Filter("bartlett", 3.0, _windowed(lambda x: (3 - x) / 3)),
        Filter("lanczos", 3.0, _windowed(lambda x: _sinc(x / 3))),
        Filter("hann", 3.0, _windowed(lambda x: 0.5 + 0.5 * np.cos(np.pi * x / 3))),
        Filter("hamming", 3.0, _windowed(lambda x: 0.54 + 0.46 * np.cos(np.pi * x / 3))),
        Filter("blackman", 3.0, _windowed(lambda x: 0.42 - 0.5 * np.cos(np.pi * x / 3 + np.pi) + 0.08 * np.cos(2 * np.pi * x / 3))),
        Filter("welch", 3.0, _windowed(lambda x: 1 - x * x / 9)),
        Filter("cosine", 3.0, _windowed(lambda x: np.cos(np.pi / 2 * (x / 3)))),
    )
}


@lru_cache(maxsize=256)
def tap_table(dst: int, src: int, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(source pixels, weights), a row for each target pixel; a row's weights add up to one, unless all are 0. Places that
    a row doesn't need have pixel 0 and weight 0."""
    ratio = src / dst
    scale = max(1.0, ratio)
    reach = np.ceil(scale * f.support)
    centre = ((np.arange(dst) + 0.5) * ratio - 0.5)[:, None]
    low = np.maximum(0, np.ceil(centre - reach))
    at = low + np.arange(int(2 * reach) + 1)
    inside = at <= np.minimum(src - 1, np.floor(centre + reach))
    raw = np.where(inside, f.kernel((at - centre) / scale), 0.0)
    total = np.cumsum(raw, axis=1)[:, -1:]  # from the first to the last, as the last bit of a sum depends on its order
    weight = np.divide(raw, total, out=raw.copy(), where=total != 0)
    return np.where(weight != 0, at, 0).astype(np.int64), weight


def taps(dst: int, src: int, f: Filter) -> list[list[tuple[int, float]]]:
    """The same as (pixel, weight) of each target pixel, without zeros."""
    index, weight = tap_table(dst, src, f)
    return [[(u, w) for u, w in zip(i, x, strict=True) if w != 0] for i, x in zip(index.tolist(), weight.tolist(), strict=True)]


def clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(x + 0.5), 0, 255).astype(np.uint8)


def _along_rows(raster: np.ndarray, dst: int, f: Filter) -> np.ndarray:
    """Resample the second to last axis of rasters (..., pixels, 4): colours weighed by alpha, rounded to bytes; no alpha at
    all gives zeros."""
    index, weight = tap_table(dst, raster.shape[-2], f)
    colour, alpha = raster[..., :3].astype(np.float64), raster[..., 3].astype(np.float64)
    shape = (*raster.shape[:-2], dst)
    sums, total = np.zeros((*shape, 3)), np.zeros(shape)
    for k in range(index.shape[1]):
        aw = alpha[..., index[:, k]] * weight[:, k]
        sums += colour[..., index[:, k], :] * aw[..., None]
        total += aw
    ok = total != 0
    out = np.zeros((*shape, 4), np.uint8)
    out[..., :3][ok] = clamp(sums[ok] * (1 / total[ok])[:, None])  # by the reciprocal: a quotient rounds some halves otherwise
    out[..., 3][ok] = clamp(total[ok])
    return out


EMPTY = np.zeros((0, 0, 4), np.uint8)


def resize(raster: np.ndarray, width: int, height: int, f: Filter) -> np.ndarray:
    """Horizontally, then vertically, with bytes between, of one raster (height, width, 4) or of many of one size (n, height,
    width, 4) at once. Negative or zero sizes, and empty rasters, give an empty one; one zero size alone isn't supported."""
    h, w = raster.shape[-3:-1]
    if width < 0 or height < 0 or (width == 0 and height == 0) or w == 0 or h == 0:
        return EMPTY
    if width == 0 or height == 0:
        raise ValueError("either size may be zero only together with the other")
    if f.support <= 0:
        ys, xs = ((np.arange(n) + 0.5) * (m / n) for n, m in ((height, h), (width, w)))
        return raster[..., ys.astype(np.int64), :, :][..., xs.astype(np.int64), :].copy()
    out = raster
    if width != w:
        out = _along_rows(out, width, f)
    if height != h or width == w:
        out = _along_rows(out.swapaxes(-3, -2), height, f).swapaxes(-3, -2)
    return np.ascontiguousarray(out)


def grey(raster: np.ndarray) -> np.ndarray:
    """height x width luminosities of 16-bit premultiplied channels."""
    wide = raster[..., :3].astype(np.int64) * 257 * raster[..., 3:].astype(np.int64) // 255
    return 0.299 * wide[..., 0] + 0.587 * wide[..., 1] + 0.114 * wide[..., 2]


def _word(bits: np.ndarray) -> np.ndarray | int:
    """Signed 64-bit words with bit n from entry n of the last two axes, of 8 x 8 bits; a number if there is only one."""
    out = np.packbits(bits.reshape(*bits.shape[:-2], 64), axis=-1, bitorder="little").view(np.int64)[..., 0]
    return out if out.ndim else int(out)


def gradient_hash(raster: np.ndarray) -> tuple[np.ndarray | int, np.ndarray | int]:
    """(row words, column words): whether each of 8 x 8 pixels of a 9 x 9 reduction is darker than its right and lower one."""
    g = grey(resize(raster, 9, 9, FILTERS["linear"]))
    return _word(g[..., :8, :8] < g[..., :8, 1:]), _word(g[..., :8, :8] < g[..., 1:, :8])


_ANGLES = np.cos(np.arange(64 * 31) / 64 * np.pi)
_BASIS = _ANGLES[(2 * np.arange(32)[None, :] + 1) * np.arange(1, 9)[:, None]]


def cosine_coefficients(raster: np.ndarray) -> np.ndarray:
    """The 64 low frequencies used, x first: only these of the 1,024 are computed."""
    g = grey(resize(raster, 32, 32, FILTERS["linear"])).swapaxes(-2, -1)
    f = 0.25 * (_BASIS @ g @ _BASIS.T)
    return f.reshape(*f.shape[:-2], 64)


def cosine_hash(raster: np.ndarray) -> np.ndarray | int:
    """Bit n: whether coefficient n is above the upper median."""
    f = cosine_coefficients(raster)
    above = f > np.sort(f, axis=-1)[..., 32:33]
    return _word(above.reshape(*above.shape[:-1], 8, 8))


def words_of_all(name: str, rasters: np.ndarray) -> list[np.ndarray]:
    """The words of many rasters of one size (n, height, width, 4), or of one; an unknown name has no words."""
    return {"dct": lambda: [cosine_hash(rasters)], "dhash": lambda: list(gradient_hash(rasters))}.get(name, list)()


def hashes(name: str, raster: np.ndarray) -> list[int]:
    """The words of one raster."""
    return words_of_all(name, raster)

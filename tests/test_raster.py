import numpy as np
import pytest

from palimpsest.functions import raster
from palimpsest.sources import png

S = np.array([[[0, 0, 0, 0], [255, 0, 0, 255]], [[0, 255, 0, 255], [0, 0, 255, 255]]], np.uint8)


@pytest.mark.parametrize(
    ("source", "w", "h", "name", "expected"),
    [
        (S, 1, 1, "box", [[(85, 85, 85, 192)]]),
        (S, 1, 2, "box", [[(255, 0, 0, 128)], [(0, 128, 128, 255)]]),
        (S, 2, 1, "box", [[(0, 255, 0, 128), (128, 0, 128, 255)]]),
        (S, 2, 2, "box", S.tolist()),
        (np.array([[[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]]], np.uint8), 1, 1, "nearest", [[(0, 255, 0, 255)]]),
    ],
)
def test_golden_resize(source, w, h, name, expected):
    assert np.array_equal(raster.resize(source, w, h, raster.FILTERS[name]), np.array(expected))


@pytest.mark.parametrize(("source", "w", "h"), [(raster.EMPTY, 1, 1), (S, 0, 0), (S, -1, 0)])
def test_empty_resize(source, w, h):
    assert raster.resize(source, w, h, raster.FILTERS["box"]).size == 0


@pytest.mark.parametrize("f", raster.FILTERS.values(), ids=lambda f: f.name)
def test_filters(f):
    assert not raster.resize(np.zeros((4, 3, 4), np.uint8), 5, 6, f).any()
    assert f.kernel(f.support + 0.0001) == 0
    if f.support:
        assert all(abs(sum(w for _, w in row) - 1) < 1e-12 for row in raster.taps(9, 32, f))


def test_white_and_black():
    white = np.full((100, 100, 4), 255, np.uint8)
    assert raster.gradient_hash(white) == (0, 0)
    assert raster.cosine_hash(np.zeros((32, 32, 4), np.uint8)) == 0


def test_cosine_hash_of_noise():
    r = np.random.default_rng(1)
    for _ in range(5):
        a = np.full((32, 32, 4), 255, np.uint8)
        a[..., :3] = r.integers(0, 256, (32, 32, 1))
        assert bin(raster.cosine_hash(a) & (2**64 - 1)).count("1") == 31


def test_png_round_trip_and_errors():
    a = np.random.default_rng(2).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    data = png.encode(a)
    assert np.array_equal(png.decode(data), a)
    for broken in (b"", b"junk", data[:40], data[:-30]):
        with pytest.raises(png.PngError):
            png.decode(broken)


def plain_pass(rows, dst, f):
    """One pass over rows of pixels, number by number."""
    out = []
    for row in rows:
        line = []
        for each in raster.taps(dst, len(row), f):
            r = g = b = a = 0.0
            for u, w in each:
                aw = row[u][3] * w
                r, g, b, a = r + row[u][0] * aw, g + row[u][1] * aw, b + row[u][2] * aw, a + aw
            byte = lambda x: int(min(255, max(0, int(x + 0.5))))
            line.append([byte(r * (1 / a)), byte(g * (1 / a)), byte(b * (1 / a)), byte(a)] if a else [0, 0, 0, 0])
        out.append(line)
    return out


@pytest.mark.parametrize("name", ["linear", "box", "lanczos"])
def test_reductions_are_those_of_a_plain_loop(name):
    r, f = np.random.default_rng(11), raster.FILTERS[name]
    for n in range(12):
        a = r.integers(0, 256, (r.integers(9, 70), r.integers(9, 70), 4)).astype(np.uint8)
        if n % 2:
            a[..., 3] = 255
        across = plain_pass(a.tolist(), 9, f)
        down = plain_pass(np.array(across).transpose(1, 0, 2).tolist(), 9, f)
        assert np.array_equal(raster.resize(a, 9, 9, f), np.array(down).transpose(1, 0, 2))


@pytest.mark.parametrize(("dst", "src"), [(9, 8), (9, 100), (32, 777), (9, 4000), (32, 20)])
def test_linear_weights_to_the_last_bit(dst, src):
    """Number by number, and added from the first to the last without compensation."""
    ratio = src / dst
    scale = max(1.0, ratio)
    for v, row in enumerate(raster.taps(dst, src, raster.FILTERS["linear"])):
        centre, total, plain = (v + 0.5) * ratio - 0.5, 0.0, []
        for u in range(src):
            w = 1.0 - abs((u - centre) / scale)
            if w > 0:
                total += w
                plain.append((u, w))
        assert row == [(u, w / total) for u, w in plain]

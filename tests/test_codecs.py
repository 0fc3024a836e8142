"""Decoders against files of the JVM's own writers, and against broken files."""

import random
import struct
import zlib

import numpy as np
import pytest

from palimpsest.sources import files, gif, jpeg, png


def picture(spark, a, kind):
    """A BufferedImage of the JVM from height x width x samples."""
    jvm = spark._jvm
    h, w, n = a.shape
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    raster, values = image.getRaster(), spark.sparkContext._gateway.new_array(jvm.int, w * n)
    for y in range(h):
        for k, v in enumerate(a[y].ravel().tolist()):
            values[k] = v
        raster.setPixels(0, y, w, 1, values)
    return image


def written(spark, image, form, progressive=False, quality=None):
    jvm = spark._jvm
    out, writer = jvm.java.io.ByteArrayOutputStream(), jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    if quality is not None:
        param.setCompressionMode(2)
        param.setCompressionQuality(quality)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def shown(spark, data):
    """height x width x 4 as the JVM decodes it; samples as they are, as its grey ones mean another scale."""
    jvm = spark._jvm
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    w, h, n = raster.getWidth(), raster.getHeight(), raster.getNumBands()
    out = np.full((h, w, 4), 255, np.uint8)
    for y in range(h):
        values = spark.sparkContext._gateway.new_array(jvm.int, w * n)
        out[y, :, :3] = np.array(list(raster.getPixels(0, y, w, 1, values))).reshape(w, n)
    return out


def smooth(h, w, n, seed=1):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    waves = [sum(r.uniform(20, 60) * np.sin(x * r.uniform(0.02, 0.2) + y * r.uniform(0.02, 0.2) + r.uniform(0, 6)) for _ in range(3)) for _ in range(n)]
    return np.clip(np.stack(waves, axis=2) + 128, 0, 255).astype(np.uint8)


# The JVM's names of kinds of images.
RGB, ARGB, GREY, GREY16, BITS, INDEXED = 5, 6, 10, 11, 12, 13


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("kind", "samples", "top"), [(RGB, 3, 256), (ARGB, 4, 256), (GREY, 1, 256), (GREY16, 1, 65536), (BITS, 1, 2)])
def test_png_kinds(spark, kind, samples, top, laced):
    r = np.random.default_rng(kind)
    for h, w in ((1, 1), (7, 9), (33, 20)):
        a = r.integers(0, top, (h, w, samples))
        data = written(spark, picture(spark, a, kind), "png", laced)
        want = np.full((h, w, 4), 255, np.uint8)
        want[..., : 4 if samples == 4 else 3] = a >> 8 if top == 65536 else a * 255 if top == 2 else a
        assert np.array_equal(png.decode(data), want)


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_png_and_gif_palettes(spark, bits):
    jvm, r = spark._jvm, np.random.default_rng(bits)
    n = 1 << bits
    colours = r.integers(0, 256, (n, 3))
    planes = [bytearray(colours[:, k].astype(np.uint8).tobytes()) for k in range(3)]
    for clear in (-1, n - 1):
        model = jvm.java.awt.image.IndexColorModel(bits, n, *planes, clear)
        a = r.integers(0, n, (21, 34, 1))
        image = jvm.java.awt.image.BufferedImage(34, 21, INDEXED if bits == 8 else BITS, model)
        raster, values = image.getRaster(), spark.sparkContext._gateway.new_array(jvm.int, 34)
        for y in range(21):
            for x, v in enumerate(a[y, :, 0].tolist()):
                values[x] = v
            raster.setPixels(0, y, 34, 1, values)
        want = np.concatenate([colours[a[..., 0]], np.full((21, 34, 1), 255)], axis=2)
        hidden = a[..., 0] == clear
        want[hidden, 3] = 0
        for laced in (False, True):
            got = png.decode(written(spark, image, "png", laced))
            assert np.array_equal(got[~hidden], want[~hidden]) and not got[hidden, 3].any()
            got = gif.decode(written(spark, image, "gif", laced))
            assert np.array_equal(got[~hidden], want[~hidden]) and not got[hidden].any()


def test_png_depths_and_transparent_colours():
    """Kinds that the other writer doesn't have, put together by hand."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def made(depth, colour, rows, *more):
        raw = zlib.compress(b"".join(b"\0" + x for x in rows))
        return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 2, len(rows), depth, colour, 0, 0, 0)) + b"".join(more) + part(b"IDAT", raw) + part(b"IEND", b"")

    assert png.decode(made(4, 0, [b"\x0f"])).tolist() == [[[0, 0, 0, 255], [255, 255, 255, 255]]]
    assert png.decode(made(2, 0, [b"\x60"], part(b"tRNS", b"\0\2"))).tolist() == [[[85, 85, 85, 255], [170, 170, 170, 0]]]
    assert png.decode(made(16, 2, [bytes(range(12))], part(b"tRNS", bytes(range(6))))).tolist() == [[[0, 2, 4, 0], [6, 8, 10, 255]]]
    assert png.decode(made(16, 4, [b"\x10\0\x80\0\x20\xff\0\0"])).tolist() == [[[16, 16, 16, 128], [32, 32, 32, 0]]]
    assert png.decode(made(8, 3, [b"\0\7"], part(b"PLTE", b"\1\2\3"))).tolist() == [[[1, 2, 3, 255], [0, 0, 0, 255]]]
    for broken in (made(3, 0, [b"\0"]), made(16, 3, [bytes(4)]), made(8, 3, [b"\0\0"]), made(8, 0, [b"\0\0"])[:-20], made(8, 0, [b"\0\0"]).replace(b"IEND", b"IENE")):
        with pytest.raises(png.PngError):
            png.decode(broken)


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_another_writer(spark, progressive):
    for h, w in ((8, 8), (40, 56), (37, 61), (1, 1)):
        grey = smooth(h, w, 1)
        data = written(spark, picture(spark, grey, GREY), "jpeg", progressive, 0.9)
        got = jpeg.decode(data)
        assert got.shape == (h, w, 4) and np.abs(got.astype(int) - shown(spark, data)).max() <= 2
        colour = smooth(h, w, 3, 5)
        data = written(spark, picture(spark, colour, RGB), "jpeg", progressive, 0.95)
        # chroma isn't smoothed here, so edges of its samples differ
        assert np.abs(jpeg.decode(data).astype(int) - shown(spark, data)).mean() < 4


def test_jpeg_sequential_and_progressive_agree(spark):
    a = np.random.default_rng(2).integers(0, 256, (50, 70, 3)).astype(np.uint8)
    image = picture(spark, a, RGB)
    assert np.array_equal(jpeg.decode(written(spark, image, "jpeg", False, 0.8)), jpeg.decode(written(spark, image, "jpeg", True, 0.8)))


def test_inverse_transform_is_near_the_exact_one():
    r = np.random.default_rng(4)
    blocks = np.zeros((200, 8, 8), np.int64)
    blocks[:, 0, 0] = r.integers(-900, 900, 200)
    for _ in range(6):
        blocks[np.arange(200), r.integers(0, 8, 200), r.integers(0, 8, 200)] = r.integers(-150, 150, 200)
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    want = np.clip(basis.T @ blocks @ basis + 128, 0, 255)
    assert np.abs(jpeg.samples_of(blocks) - want).max() <= 1.01


def test_colours_of_samples():
    y, cb, cr = (np.array(x, np.uint8) for x in ([0, 255, 128, 76], [128, 128, 128, 85], [128, 128, 128, 255]))
    assert np.stack(jpeg.rgb_of(y, cb, cr), axis=1).tolist() == [[0, 0, 0], [255, 255, 255], [128, 128, 128], [254, 0, 0]]


def test_inks_and_plain_colours():
    flat = [np.full((2, 2), v, np.uint8) for v in (255, 0, 128, 255)]
    assert jpeg._coloured(flat, [1, 2, 3, 4], False, 0)[0, 0].tolist() == [255, 0, 128, 255]
    assert jpeg._coloured([*flat[:3], np.zeros((2, 2), np.uint8)], [1, 2, 3, 4], False, 0)[0, 0].tolist() == [0, 0, 0, 255]
    assert jpeg._coloured(flat[:3], [82, 71, 66], False, None)[0, 0].tolist() == [255, 0, 128, 255]
    with pytest.raises(jpeg.JpegError):
        jpeg._coloured(flat, [1, 2, 3, 4], True, None)


def test_jpeg_restart_markers(spark):
    """A scan cut by restart markers: the same blocks, each part beginning anew."""
    data = written(spark, picture(spark, np.full((8, 16, 1), 90, np.uint8), GREY), "jpeg", False, 0.9)
    at = data.index(b"\xff\xda")
    head = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
    one = jpeg.decode(data)
    alone = written(spark, picture(spark, np.full((8, 8, 1), 90, np.uint8), GREY), "jpeg", False, 0.9)
    start = alone.index(b"\xff\xda")
    body = alone[start + 2 + struct.unpack_from(">H", alone, start + 2)[0] : alone.rindex(b"\xff\xd9")]
    cut = data[:at] + b"\xff\xdd\0\4\0\1" + data[at:head] + body + b"\xff\xd0" + body + b"\xff\xd9"
    assert np.array_equal(jpeg.decode(cut), one)


def test_broken_files_raise_nothing_else(spark):
    r = random.Random(3)
    a = smooth(24, 30, 3)
    image = picture(spark, a, RGB)
    kinds = [(written(spark, image, "jpeg", p, 0.8), jpeg.decode, (jpeg.JpegError,)) for p in (False, True)]
    kinds.append((written(spark, image, "png"), png.decode, (png.PngError, ValueError)))
    kinds.append((written(spark, picture(spark, smooth(24, 30, 1), GREY), "gif"), gif.decode, (gif.GifError,)))
    for data, decode, errors in kinds:
        for _ in range(150):
            broken = bytearray(data)
            for _ in range(r.randrange(1, 5)):
                broken[r.randrange(len(broken))] = r.randrange(256)
            if r.random() < 0.4:
                broken = broken[: r.randrange(len(broken))]
            try:
                assert decode(bytes(broken)).shape[2] == 4
            except errors:
                pass


def test_files_are_known_by_their_first_bytes(spark, tmp_path):
    a = smooth(20, 20, 3)
    image = picture(spark, a, RGB)
    for form, name in (("jpeg", "a.png"), ("png", "b.jpg"), ("gif", "c.jpeg")):
        (tmp_path / name).write_bytes(written(spark, image, form))
    (tmp_path / "d.png").write_bytes(b"nothing")
    from palimpsest.spec import DHASH

    prints, errors = files.fingerprints(files.listed(spark, [str(p) for p in sorted(tmp_path.iterdir())]), DHASH)
    assert prints.count() == 3 and [r["path"][-5:] for r in errors.collect()] == ["d.png"]
    of_folder = files.folder_files(spark, str(tmp_path))
    assert [r["id"] for r in of_folder.orderBy("path").collect()] == [1, 2, 3, 4]
    again, _ = files.folder_fingerprints(spark, str(tmp_path), DHASH)
    assert {(r["w0"], r["w1"]) for r in again.collect()} == {(r["w0"], r["w1"]) for r in prints.collect()}

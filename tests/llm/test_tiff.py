"""TIFF against files of another writer, published examples and broken files."""

import random
import struct

import numpy as np
import pytest

from palimpsest.llm import tiff


def test_published_examples():
    """The run-length example of the format's own description, and the string table's example."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) == tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))


def by_java(spark, kind, compression, tile=None, pages=1, seed=1):
    """(file, pages' pixels) written by the JVM's own TIFF writer."""
    jvm = spark._jvm
    r = np.random.default_rng(seed)
    types = {"grey": (10, 1), "rgb": (5, 3), "bits": (12, 1), "grey16": (11, 1)}
    out, shown = jvm.java.io.ByteArrayOutputStream(), []
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.prepareWriteSequence(None)
    for _ in range(pages):
        h, w = int(r.integers(20, 90)), int(r.integers(20, 90))
        image = jvm.java.awt.image.BufferedImage(w, h, types[kind][0])
        samples = types[kind][1]
        a = r.integers(0, {"bits": 2, "grey16": 65536}.get(kind, 256), (h, w, samples))
        a[: h // 2] = a[:1, :1]
        raster = image.getRaster()
        values = spark.sparkContext._gateway.new_array(jvm.int, w * samples)
        for y in range(h):
            for k, v in enumerate(a[y].ravel().tolist()):
                values[k] = v
            raster.setPixels(0, y, w, 1, values)
        param = writer.getDefaultWriteParam()
        param.setCompressionMode(2)
        param.setCompressionType(compression)
        if tile:
            param.setTilingMode(2)
            param.setTiling(tile[0], tile[1], 0, 0)
        writer.writeToSequence(jvm.javax.imageio.IIOImage(image, None, None), param)
        shown.append(a)
    writer.endWriteSequence()
    stream.flush()
    return bytes(out.toByteArray()), shown


@pytest.mark.parametrize("kind", ["grey", "rgb", "bits", "grey16"])
@pytest.mark.parametrize("compression", ["LZW", "PackBits", "Deflate", "ZLib"])
def test_files_of_another_writer(spark, kind, compression):
    for tile, pages in ((None, 2), ((32, 16), 1)):
        data, shown = by_java(spark, kind, compression, tile, pages)
        got = list(tiff.read(data))
        assert len(got) == pages
        for p, a in zip(got, shown, strict=True):
            assert not isinstance(p, str), p
            assert np.array_equal(p.pixels, a) and p.tiled == bool(tile)


def sample_file():
    a = np.arange(64 * 48, dtype=np.uint32).astype(np.uint8).reshape(64, 48)
    return tiff.write([{"pixels": a, "compression": c, "predictor": p, "tile": t} for c, p, t in ((tiff.LZW, 2, None), (tiff.DEFLATE, 1, (16, 16)), (tiff.PACKBITS, 1, None))])


def test_broken_files_never_raise():
    whole, r = sample_file(), random.Random(5)
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(len(data))] = r.choice((0, 1, 2, 255, r.randrange(256)))
        if r.random() < 0.3:
            data = data[: r.randrange(len(data))]
        for p in tiff.read(bytes(data)):
            assert isinstance(p, (str, tiff.Page))


def directory(fields, body=b""):
    """A file of one directory with these (tag, type, count, value)."""
    out = struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    for tag, kind, n, value in fields:
        out += struct.pack("<HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack("<I", value)).ljust(4, b"\0")
    return out + struct.pack("<I", 0) + body


@pytest.mark.parametrize(
    "fields",
    [
        [(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 0), (279, 4, 1, 64)],  # no rows a strip
        [(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (324, 4, 1, 8), (325, 4, 1, 64)],  # tiles without a size
        [(256, 2, 1, b"8\0"), (257, 4, 1, 8), (273, 4, 1, 8), (279, 4, 1, 64)],  # a width in letters
        [(256, 4, 1, 4_000_000_000), (257, 4, 1, 4_000_000_000), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 64)],  # a page without end
        [(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (277, 3, 1, 0), (273, 4, 1, 8), (279, 4, 1, 64)],
        [(256, 11, 1, struct.pack("<f", float("nan"))), (257, 4, 1, 8)],
        [(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (322, 4, 1, 4_000_000_000), (323, 4, 1, 16), (324, 4, 1, 8), (325, 4, 1, 64)],
        [],
    ],
)
def test_malformed_headers_give_an_error_row(spark, fields):
    data = directory(fields, bytes(64))
    rows = tiff.pages(spark.createDataFrame([(1, data), (2, sample_file())], "id long, content binary")).collect()
    assert [(r["id"], r["page"], r["error"] is None) for r in sorted(rows, key=lambda r: (r["id"], r["page"]))] == [(1, 0, False), (2, 0, True), (2, 1, True), (2, 2, True)]


def test_output_is_bounded():
    import zlib

    body = zlib.compress(bytes(50_000_000))
    data = directory([(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8 + 2 + 6 * 12 + 4), (279, 4, 1, len(body))], body)
    (page,) = tiff.read(data)
    assert page.pixels.shape == (8, 8, 1) and not page.pixels.any()
    assert len(tiff.packbits_decode(bytes([129, 7]) * 1000, 300)) <= 300 + 128
    assert len(tiff.lzw_decode(tiff.lzw_encode(bytes(5_000_000)), 1000)) < 10_000


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.DEFLATE, tiff.LZW])
def test_order_of_bits(compression):
    """A file with FillOrder 2 holds each byte the other way round."""
    import zlib

    raw = bytes([0b10000000, 0b11001010])
    body = {tiff.NONE: bytes, tiff.PACKBITS: tiff.packbits_encode, tiff.DEFLATE: zlib.compress, tiff.LZW: tiff.lzw_encode}[compression](raw)
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in body)
    for order, stored in ((1, body), (2, turned)):
        fields = [(256, 4, 1, 8), (257, 4, 1, 2), (258, 3, 1, 1), (259, 3, 1, compression), (266, 3, 1, order), (273, 4, 1, 8 + 2 + 7 * 12 + 4), (279, 4, 1, len(stored))]
        (page,) = tiff.read(directory(fields, stored))
        assert page.pixels[:, :, 0].tolist() == [[1, 0, 0, 0, 0, 0, 0, 0], [1, 1, 0, 0, 1, 0, 1, 0]]
    (bad,) = tiff.read(directory([(256, 4, 1, 8), (257, 4, 1, 2), (266, 3, 1, 3)]))
    assert "order of bits" in bad


def test_segments_are_the_pages_in_parts(spark, monkeypatch):
    data = sample_file()
    whole = list(tiff.read(data))
    rows = tiff.segments(spark.createDataFrame([(1, data), (2, None), (3, b"no"), (4, b"")], "id long, content binary")).collect()
    for n, page in enumerate(whole):
        seen = np.zeros((page.height, page.width), int)
        for r in rows:
            if (r["id"], r["page"]) == (1, n):
                a = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["samples"])
                assert np.array_equal(a, page.pixels[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]])
                seen[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]] += 1
        assert (seen == 1).all()
    assert sorted((r["id"], r["error"]) for r in rows if r["error"]) == [(2, "no content"), (3, "not a TIFF file"), (4, "not a TIFF file")]
    monkeypatch.setattr(tiff, "PAGE_BYTES", 1000)  # pages are too large for a row, their tiles and strips are not
    assert all("too large" in p for p in tiff.read(data))
    assert [n for n, _, part in tiff.read_segments(data) if not isinstance(part, str)].count(1) == 12


def chain(links):
    """A file whose k-th directory, without fields, is followed by the one that links name; None: the end."""
    at = [8 + 6 * k for k in range(len(links))]
    return struct.pack("<2sHI", b"II", 42, 8) + b"".join(struct.pack("<HI", 0, 0 if k is None else at[k]) for k in links)


def test_chains_of_any_length_and_loops():
    r = random.Random(4)
    for _ in range(300):
        links = [r.choice([None, *range(9)]) if r.random() < 0.4 else min(k + 1, 8) for k in range(9)]
        at, met = 0, []
        while at is not None and at not in met:
            met.append(at)
            at = links[at]
        got = list(tiff.read(chain(links)))
        assert len(got) == len(met) + (at is not None) and (got[-1] == "image directories form a loop") == (at is not None)
    assert sum(1 for _ in tiff.read(chain([*range(1, 70_001), None]))) == 70_001

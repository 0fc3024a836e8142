"""A PNG decoder to 8-bit RGBA: all colour types and bit depths, interlaced or not, transparency chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: samples a pixel and bits a sample by colour type; passes of interlacing (x, y, step x, step y).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class PngError(ValueError):
    pass


def _unfilter(raw: bytes, at: int, rows: int, line: int, step: int) -> tuple[np.ndarray, int]:
    out = np.zeros((rows, line), np.uint8)
    above = np.zeros(line, np.uint8)
    if at + rows * (line + 1) > len(raw):
        raise PngError("truncated image data")
    for y in range(rows):
        kind, row = raw[at], np.frombuffer(raw, np.uint8, line, at + 1).copy()
        at += line + 1
        if kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            r, up = row.tolist(), above.tolist()
            for i in range(line):
                a, b = (r[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                r[i] = (r[i] + guess) & 255
            row = np.array(r, np.uint8)
        elif kind:
            raise PngError("unknown filter")
        out[y] = above = row
    return out, at


def _samples(rows: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.reshape(len(rows), width * samples, 2).view(">u2").reshape(len(rows), width, samples).astype(np.uint16)
    if depth == 8:
        return rows.reshape(len(rows), width, samples).astype(np.uint16)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, : width * samples].reshape(len(rows), width, samples).astype(np.uint16)


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes; 16-bit samples keep their high byte. Raises PngError on anything broken."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG file")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise PngError("truncated chunk")
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + chunk)):
            raise PngError("wrong checksum")
        if kind == b"IHDR":
            if size != 13:
                raise PngError("broken header")
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            if size % 3 or size > 768:
                raise PngError("broken palette")
            palette = np.zeros((256, 3), np.uint8)  # colours outside the palette are black
            palette[: size // 3] = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not body:
        raise PngError("no image in the file")
    width, height, depth, colour, _, _, laced = head
    if depth not in DEPTHS.get(colour, ()) or laced > 1 or not width or not height:
        raise PngError("unknown form")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as x:
        raise PngError(str(x)) from x
    n = SAMPLES[colour]
    values, at = np.zeros((height, width, n), np.uint16), 0
    for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            rows, at = _unfilter(raw, at, h, (w * n * depth + 7) // 8, max(1, n * depth // 8))
            values[y0::dy, x0::dx] = _samples(rows, w, n, depth)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise PngError("no palette")
        out[..., :3] = palette[values[..., 0]]
        if clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out[..., 3] = alpha[values[..., 0]]
        return out
    scaled = (values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[..., :3] = scaled[..., :1] if colour in (0, 4) else scaled[..., :3]
    if colour in (4, 6):
        out[..., 3] = scaled[..., -1]
    elif clear:
        if len(clear) < 2 * n:
            raise PngError("broken transparency")
        key = np.frombuffer(clear, ">u2", n)
        out[..., 3] = np.where((values == key).all(axis=2), 0, 255)
    return out


def encode(raster: np.ndarray, kind: str = "rgba") -> bytes:
    """An unfiltered file of a kind: rgba, laced (the same, interlaced), rgb, grey and grey16 (the red samples), palette
    (at most 256 colours without alpha)."""
    h, w = raster.shape[:2]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    depth, colour, more = 8, {"rgba": 6, "laced": 6, "rgb": 2, "grey": 0, "grey16": 0, "palette": 3}[kind], b""
    values = {6: raster, 2: raster[..., :3], 0: raster[..., :1]}.get(colour)
    if kind == "grey16":
        depth, values = 16, np.concatenate([values, values], axis=2)
    elif kind == "palette":
        colours, index = np.unique(raster[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
        values, more = index.reshape(h, w, 1).astype(np.uint8), part(b"PLTE", colours.astype(np.uint8).tobytes())
    passes = [values[y0::dy, x0::dx] for x0, y0, dx, dy in PASSES] if kind == "laced" else [values]
    raw = b"".join(b"\0" + row.tobytes() for each in passes if each.size for row in each)
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, kind == "laced")) + more + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

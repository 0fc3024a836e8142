"""A JPEG decoder to 8-bit RGBA: sequential and progressive Huffman-coded files of 8-bit samples, grey, colour and four inks.

Entropy-coded data goes bit by bit in Python; dequantising, the inverse transform
and colours run on whole planes. The transform is the integer one of the MPEG
reference decoder, and chroma isn't smoothed: a pixel takes the sample that covers it.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np

# Fixed values of the format: the order of coefficients in a block, by row and column along its diagonals.
ORDER = sorted(range(64), key=lambda n: (n // 8 + n % 8, n // 8 if (n // 8 + n % 8) % 2 else n % 8))
# 2048 * sqrt(2) * cos(k * pi / 16) for k = 1, 2, 3, 5, 6, 7, and 256 / sqrt(2).
W1, W2, W3, W5, W6, W7, R2 = 2841, 2676, 2408, 1609, 1108, 565, 181


class JpegError(ValueError):
    pass


class Bits:
    """The entropy-coded bytes of a scan between two restart markers, without stuffed zeros; zeros follow the end."""

    def __init__(self, data: bytes) -> None:
        data = data.replace(b"\xff\x00", b"\xff")
        self.limit = 8 * len(data) + 64
        self.words = np.frombuffer(data + bytes(-len(data) % 4 + 64), ">u4").tolist()
        self.at = self.held = self.have = 0

    def fill(self) -> None:
        if 32 * self.at > self.limit:
            raise JpegError("truncated image data")
        self.held = (self.held & ((1 << self.have) - 1)) << 32 | (self.words[self.at] if self.at < len(self.words) else 0)
        self.have += 32
        self.at += 1

    def symbol(self, table: list[int]) -> int:
        if self.have < 16:
            self.fill()
        found = table[(self.held >> (self.have - 16)) & 0xFFFF]
        if not found:
            raise JpegError("unknown code")
        self.have -= found >> 8
        return found & 255

    def number(self, n: int) -> int:
        """n bits, as the format has signed numbers."""
        if not n:
            return 0
        if self.have < n:
            self.fill()
        self.have -= n
        x = (self.held >> self.have) & ((1 << n) - 1)
        return x if x >> (n - 1) else x - (1 << n) + 1

    def plain(self, n: int) -> int:
        if self.have < n:
            self.fill()
        self.have -= n
        return (self.held >> self.have) & ((1 << n) - 1)


def code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For the next 16 bits: length of the code there times 256, and its symbol; 0 where none is."""
    out, code, k = [0] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            first, step = code << (16 - size), 1 << (16 - size)
            if first + step > 65536:
                raise JpegError("broken code table")
            out[first : first + step] = [size << 8 | symbols[k]] * step
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Plane:
    """A component: its sampling, tables, and coefficients of all its blocks."""

    def __init__(self, key: int, h: int, v: int, table: int) -> None:
        self.key, self.h, self.v, self.table = key, h, v, table
        self.last = self.wide = self.high = 0
        self.values = array("i")

    def size(self, across: int, down: int) -> None:
        self.wide, self.high = across * self.h, down * self.v
        self.values = array("i", bytes(4 * 64 * self.wide * self.high))


def _sequential(bits: Bits, p: Plane, at: int, dc: list[int], ac: list[int]) -> None:
    values = p.values
    p.last += bits.number(bits.symbol(dc) & 15)
    values[at] = p.last
    k = 1
    while k < 64:
        both = bits.symbol(ac)
        size = both & 15
        if size:
            k += both >> 4
            if k > 63:
                raise JpegError("too many coefficients")
            values[at + ORDER[k]] = bits.number(size)
            k += 1
        elif both == 0xF0:
            k += 16
        else:
            break


class Progress:
    """What a progressive scan goes on with: a run of blocks without further coefficients."""

    def __init__(self, first: int, last: int, high: int, low: int) -> None:
        self.first, self.last, self.high, self.low, self.run = first, last, high, low, 0

    def block(self, bits: Bits, p: Plane, at: int, dc: list[int] | None, ac: list[int] | None) -> None:
        values, low = p.values, self.low
        if self.first == 0:
            if self.high:
                values[at] |= bits.plain(1) << low
            else:
                p.last += bits.number(bits.symbol(dc) & 15)
                values[at] = p.last << low
        elif self.high:
            self.refine(bits, values, at, ac)
        elif self.run:
            self.run -= 1
        else:
            k = self.first
            while k <= self.last:
                both = bits.symbol(ac)
                skip, size = both >> 4, both & 15
                if size:
                    k += skip
                    if k > 63:
                        raise JpegError("too many coefficients")
                    values[at + ORDER[k]] = bits.number(size) << low
                    k += 1
                elif skip == 15:
                    k += 16
                else:
                    self.run = (1 << skip) + (bits.plain(skip) if skip else 0) - 1
                    break

    def refine(self, bits: Bits, values: array, at: int, ac: list[int]) -> None:
        k, step = self.first, 1 << self.low
        if not self.run:
            while k <= self.last:
                both = bits.symbol(ac)
                skip, new = both >> 4, 0
                if both & 15:
                    new = step if bits.plain(1) else -step
                elif skip < 15:
                    self.run = (1 << skip) + (bits.plain(skip) if skip else 0)
                    break
                while k <= self.last:  # known coefficients are corrected on the way, unknown ones counted
                    i = at + ORDER[k]
                    k += 1
                    if values[i]:
                        if bits.plain(1):
                            values[i] += step if values[i] > 0 else -step
                    elif skip:
                        skip -= 1
                    else:
                        values[i] = new
                        break
        if self.run:
            for j in range(k, self.last + 1):
                i = at + ORDER[j]
                if values[i] and bits.plain(1):
                    values[i] += step if values[i] > 0 else -step
            self.run -= 1


def _turned(x: list[np.ndarray], shift: int, round_: int, last: int, scale: int) -> list[np.ndarray]:
    """Eight inputs of the transform in one direction, in an order of their own, to eight outputs."""
    a0, a1 = (x[0] << scale) + round_, x[4] << scale
    half = 4 if shift else 0
    t = W7 * (x[1] + x[7]) + half
    b4, b5 = (t + (W1 - W7) * x[1]) >> shift, (t - (W1 + W7) * x[7]) >> shift
    t = W3 * (x[5] + x[3]) + half
    b6, b7 = (t - (W3 - W5) * x[5]) >> shift, (t - (W3 + W5) * x[3]) >> shift
    c8, c0 = a0 + a1, a0 - a1
    t = W6 * (x[2] + x[6]) + half
    c2, c3 = (t - (W2 + W6) * x[6]) >> shift, (t + (W2 - W6) * x[2]) >> shift
    c1, c4, c6, c5 = b4 + b6, b4 - b6, b5 + b7, b5 - b7
    d7, d8, d3, d0 = c8 + c3, c8 - c3, c0 + c2, c0 - c2
    d2, d4 = (R2 * (c4 + c5) + 128) >> 8, (R2 * (c4 - c5) + 128) >> 8
    return [y >> last for y in (d7 + c1, d3 + d2, d0 + d4, d8 + c6, d8 - c6, d0 - d4, d3 - d2, d7 - c1)]


def samples_of(blocks: np.ndarray) -> np.ndarray:
    """n x 8 x 8 dequantised coefficients to bytes."""
    b = blocks.astype(np.int32)
    b = np.stack(_turned([b[:, :, k] for k in range(8)], 0, 128, 8, 11), axis=2)
    b = np.stack(_turned([b[:, k, :] for k in range(8)], 3, 8192, 14, 8), axis=1)
    return (np.clip(b, -128, 127) + 128).astype(np.uint8)


def _scan(planes: list[Plane], tables: list[tuple], segments: list[bytes], across: int, down: int, sizes: dict[int, tuple[int, int]], interval: int, progress: Progress | None) -> None:
    """Decodes the blocks of one scan; planes: those it has."""
    alone = len(planes) == 1
    if alone:  # blocks of one component go in rows, only those that the picture needs
        p = planes[0]
        wide, high = sizes[p.key]
        units = [[(p, 64 * (y * p.wide + x), *tables[0])] for y in range(high) for x in range(wide)]
    else:
        units = [[(p, 64 * ((my * p.v + v) * p.wide + mx * p.h + h), *t) for p, t in zip(planes, tables, strict=True) for v in range(p.v) for h in range(p.h)] for my in range(down) for mx in range(across)]
    interval = interval or len(units)
    for n, start in enumerate(range(0, len(units), interval)):
        if n >= len(segments):
            raise JpegError("truncated image data")
        bits = Bits(segments[n])
        for p in planes:
            p.last = 0
        if progress:
            progress.run = 0
        for unit in units[start : start + interval]:
            for p, at, dc, ac in unit:
                if progress:
                    progress.block(bits, p, at, dc, ac)
                else:
                    _sequential(bits, p, at, dc, ac)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """(entropy-coded data between restart markers, where the next marker is)."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]], at


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes. Raises JpegError on anything broken or of another kind."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG file")
    try:
        return _decoded(data)
    except JpegError:
        raise
    except (struct.error, ValueError, IndexError, KeyError, TypeError, OverflowError) as x:
        raise JpegError(f"broken file: {x!r}") from x


def _decoded(data: bytes) -> np.ndarray:
    at, planes, quant, codes = 2, [], {}, {}
    width = height = interval = across = down = 0
    progressive, jfif, adobe, sizes, seen = False, False, None, {}, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif kind == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                codes[body[k]] = code_table(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1, 0xC2):
            if planes:
                raise JpegError("several frames")
            progressive = kind == 0xC2
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not width or not height or n not in (1, 3, 4):
                raise JpegError(f"{depth} bits a sample, {n} components, {width} x {height}: not supported")
            planes = [Plane(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if n == 1:
                planes[0].h = planes[0].v = 1
            if any(not 1 <= p.h <= 4 or not 1 <= p.v <= 4 for p in planes):
                raise JpegError("unknown sampling")
            h, v = max(p.h for p in planes), max(p.v for p in planes)
            if any(h % p.h or v % p.v for p in planes):
                raise JpegError("sampling that isn't a whole ratio")
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for p in planes:
                p.size(across, down)
                sizes[p.key] = (-(-(-(-width * p.h // h)) // 8), -(-(-(-height * p.v // v)) // 8))
        elif 0xC3 <= kind <= 0xCF:
            raise JpegError("lossless and arithmetic-coded files aren't supported")
        elif kind == 0xDD:
            (interval,) = struct.unpack_from(">H", body)
        elif kind == 0xE0:
            jfif = jfif or body[:5] == b"JFIF\0"
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind == 0xDA:
            of = {p.key: p for p in planes}
            chosen = [of[body[1 + 2 * k]] for k in range(body[0])]
            tables = [(codes.get(body[2 + 2 * k] >> 4), codes.get(16 | body[2 + 2 * k] & 15)) for k in range(body[0])]
            first, last, both = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            if progressive and (last > 63 or first > last):
                raise JpegError("broken scan")
            segments, at = _segments(data, at)
            _scan(chosen, tables, segments, across, down, sizes, interval, Progress(first, last, both >> 4, both & 15) if progressive else None)
            seen = True
    if not seen:
        raise JpegError("no image in the file")
    return _coloured([_whole(p, quant, width, height, planes) for p in planes], [p.key for p in planes], jfif, adobe)


def _whole(p: Plane, quant: dict[int, np.ndarray], width: int, height: int, planes: list[Plane]) -> np.ndarray:
    """A component's samples, one a pixel of the picture."""
    blocks = np.frombuffer(p.values, np.int32).reshape(-1, 64).copy()
    table = np.empty(64, np.int32)
    table[ORDER] = quant[p.table]
    samples = samples_of((blocks * table).reshape(-1, 8, 8)).reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
    h, v = max(x.h for x in planes) // p.h, max(x.v for x in planes) // p.v
    return samples[np.arange(height) // v][:, np.arange(width) // h]


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    # 65536 times the factors of the two colour differences, and of the luminance times 1 + 1 / 256 + 1 / 65536.
    light, b, r = y.astype(np.int64) * 0x10101, cb.astype(np.int64) - 128, cr.astype(np.int64) - 128
    return [np.clip(x >> 16, 0, 255).astype(np.uint8) for x in (light + 91881 * r, light - 22554 * b - 46802 * r, light + 116130 * b)]


def _coloured(samples: list[np.ndarray], keys: list[int], jfif: bool, adobe: int | None) -> np.ndarray:
    out = np.full((*samples[0].shape, 4), 255, np.uint8)
    if len(samples) == 1:
        out[..., :3] = samples[0][..., None]
    elif len(samples) == 3:
        plain = not jfif and (adobe == 0 or bytes(keys) == b"RGB")
        for k, x in enumerate(samples if plain else rgb_of(*samples)):
            out[..., k] = x
    else:
        if adobe is None:
            raise JpegError("four components without a note of their colours")
        inks = rgb_of(*samples[:3]) if adobe else [255 - x for x in samples[:3]]  # such files have their inks inverted
        black = 0xFFFF - (255 - samples[3].astype(np.int64)) * 0x101
        for k, x in enumerate(inks):
            out[..., k] = (0xFFFF - x.astype(np.int64) * 0x101) * black // 0xFFFF >> 8
    return out

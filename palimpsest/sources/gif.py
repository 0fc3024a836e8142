"""A decoder of the first picture of a GIF file to 8-bit RGBA: the picture's own rectangle, not the whole screen."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: first line and step of each pass of an interlaced picture.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class GifError(ValueError):
    pass


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def unpacked(data: bytes, least: int, size: int) -> bytes:
    """Codes of least + 1 bits and more, the lowest first, to so many bytes."""
    if not 2 <= least <= 8:
        raise GifError("unknown code size")
    clear, end = 1 << least, (1 << least) + 1
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    out, have, held, bits, wide, last = [], 0, 0, 0, least + 1, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= wide:
            code = held & ((1 << wide) - 1)
            held >>= wide
            bits -= wide
            if code == clear:
                del table[end + 1 :]
                wide, last = least + 1, b""
                continue
            if code == end or have >= size:
                return b"".join(out)[:size]
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise GifError("unknown code")
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << wide and wide < 12:
                    wide += 1
            out.append(entry)
            have += len(entry)
            last = entry
    return b"".join(out)[:size]


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes. Raises GifError on anything broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF file")
    try:
        return _decoded(data)
    except (struct.error, IndexError) as x:
        raise GifError(f"broken file: {x!r}") from x


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 128:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("truncated colours")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _decoded(data: bytes) -> np.ndarray:
    _, _, flags = struct.unpack_from("<HHB", data, 6)
    common, at = _colours(data, 13, flags)
    clear = None
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            what = data[at + 1]
            body, at = _blocks(data, at + 2)
            if what == 0xF9 and len(body) >= 4:
                clear = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            _, _, width, height, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _colours(data, at + 10, flags)
            colours = own if own is not None else common
            if colours is None or not width or not height:
                raise GifError("no colours, or a picture without size")
            body, _ = _blocks(data, at + 1)
            index = np.frombuffer(unpacked(body, data[at], width * height), np.uint8)
            if len(index) < width * height:
                raise GifError("truncated image data")
            index = index.reshape(height, width)
            if flags & 64:
                order = np.concatenate([np.arange(first, height, step) for first, step in PASSES])
                index = index[np.argsort(order)]
            palette = np.full((256, 4), 255, np.uint8)
            palette[: len(colours), :3] = colours
            if clear is not None:
                palette[clear] = 0
            if int(index.max()) >= max(len(colours), -1 if clear is None else clear + 1):
                raise GifError("a colour outside the table")
            return palette[index]
        elif kind == 0x3B:
            break
        else:
            raise GifError("unknown block")
    raise GifError("no image in the file")

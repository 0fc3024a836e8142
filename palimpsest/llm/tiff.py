"""Media columns: TIFF files to rows, one row a page, and a writer of the same files.

Reading walks the chain of image directories in either byte order, gathers the
strips or tiles of each, undoes PackBits, LZW or deflate compression and
horizontal differencing, and places tiles. Pages may have 1, 8 or 16 bits a
sample, several samples a pixel, contiguous or in separate planes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .textkernel import to_bytes

# Fixed values of the format: tags, field types' struct codes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
FILL_ORDER, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 266, 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}

#: The query's pages: samples a row, rows a page, rows a strip, a tile's width and height.
PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 64, 16, (192, 16)


#: Bytes of samples that a page's row may have, as a row of Spark has a limit of 2 GB. Larger pages are an error in pages(),
#: and whole in segments(), which gives a row for each strip or tile.
PAGE_BYTES = 1 << 30
#: Bytes of pages that are passed on together.
BATCH_BYTES = 16 << 20


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    """Of the output no more than the run goes on in which it reaches so many bytes."""
    out, i, n, size = [], 0, len(data), 0
    while i < n and (most is None or size < most):
        k = data[i]
        if k < 128:
            part = data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            part = data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        size += len(part)
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(cut, len(a)))
    out, literal = [], 0

    def literals(upto: int) -> None:
        for s in range(literal, upto, 128):
            part = data[s : min(s + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for at, n in zip(cut[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        literals(at)
        for s in range(0, n, 128):
            k = min(128, n - s)
            out.append(bytes([257 - k, data[at]]) if k > 1 else bytes([0, data[at]]))
        literal = at + n
    literals(len(data))
    return b"".join(out)


#: Codes between two clear codes as written here, and the width of each: 9 to 12 bits, each width left one code early.
#: Other writers' runs may go on until the table is full, and some codes further.
RUN, LONGEST = 4093 - 258 + 1, 4096 - 258 + 4096
_WIDTHS = np.array([9 if k < 254 else 10 if k < 766 else 11 if k < 1790 else 12 for k in range(LONGEST)])
_ENDS = np.cumsum(_WIDTHS)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; a clear code begins the data and every run of RUN codes. The table maps
    code * 256 + byte to the code of the longer string."""
    codes, widths = [np.array([256])], [np.array([9])]
    run: list[int] = []
    table: dict[int, int] = {}
    get, add, nxt = table.get, run.append, 258
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        prefix = byte
        table[key] = nxt
        nxt += 1
        if nxt == 258 + RUN:
            run.append(256)
            codes.append(np.array(run))
            widths.append(_WIDTHS[: len(run)])
            run.clear()
            table.clear()
            nxt = 258
    if prefix >= 0:
        run.append(prefix)
    run.append(257)
    codes.append(np.array(run))
    widths.append(_WIDTHS[: len(run)])
    code, width = np.concatenate(codes), np.concatenate(widths)
    bits = (code[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Within a run all widths are known, so its codes are cut out at once; strings are then looked up one by one. Stops
    after the run in which so many bytes are reached, or with an error far beyond them."""
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at, out, have = 8 * len(data), 0, [], 0
    while at + 9 <= total and (most is None or have < most):
        ends = at + _ENDS
        ends = ends[ends <= total]
        first = ends - _WIDTHS[: len(ends)]
        byte = first >> 3
        word = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        codes = (word >> (24 - (first & 7) - _WIDTHS[: len(ends)])) & ((1 << _WIDTHS[: len(ends)]) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = _START[:], b""
        add = table.append
        size = 258
        for k, code in enumerate(codes[:n].tolist()):
            if k == 0:
                if code >= size:
                    raise TiffError("broken LZW data")
                last = table[code]
            else:
                if code < size:
                    entry = table[code]
                    if size < 4096:
                        add(last + entry[:1])
                elif code == size < 4096:
                    entry = last + last[:1]
                    add(entry)
                else:
                    raise TiffError("broken LZW data")
                size += size < 4096
                last = entry
            out.append(last)
            have += len(last)
            if most is not None and have > most + 4096:
                break
        if not len(stop) or codes[n] == 257:
            break
        at = int(ends[n])
    return b"".join(out)


_START = [bytes([i]) for i in range(256)] + [b"", b""]


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise TiffError(f"compression {compression} isn't supported")


#: Each byte with its bits in the other order.
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


@dataclass
class Form:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    tiled: bool
    predictor: int
    parts: Iterator[tuple[int, int, int, np.ndarray]]  # first row, first column, plane, rows x columns x samples


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    tiled: bool
    predictor: int
    pixels: np.ndarray  # height x width x samples


def _directory(data: bytes, at: int, e: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(e + "H", data, at)
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(e + code) * n
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        if where + size > len(data):
            raise TiffError("a field lies outside the file")
        tags[tag] = (data[where : where + n],) if code == "s" else struct.unpack_from(f"{e}{n * len(code)}{code[0]}", data, where)
    (after,) = struct.unpack_from(e + "I", data, at + 2 + 12 * count)
    return tags, after


def _segment(data: bytes, rows: int, width: int, samples: int, bits: int, compression: int, predictor: int, e: str) -> np.ndarray:
    raw = _unpacked(data, compression, rows * ((width * samples * bits + 7) // 8))
    if bits == 1:
        if predictor != 1:
            raise TiffError("a predictor of single bits")
        line = (width * samples + 7) // 8
        if len(raw) < rows * line:
            raise TiffError("a strip or tile is short")
        a = np.frombuffer(raw, np.uint8, min(len(raw), rows * line)).reshape(-1, line)
        out = np.unpackbits(a, axis=1)[:, : width * samples].reshape(-1, width, samples)
    else:
        kind = np.dtype(f"{e}u{bits // 8}")
        line = width * samples * kind.itemsize
        a = np.frombuffer(raw, kind, min(len(raw) // line, rows) * width * samples)
        out = a.reshape(-1, width, samples).astype(kind.newbyteorder("="))
    if len(out) < rows:
        raise TiffError("a strip or tile is short")
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} isn't supported")
    return out


def _whole(tags: dict[int, tuple], tag: int) -> tuple[int, ...] | None:
    """A field's values, which must be whole numbers that aren't negative."""
    found = tags.get(tag)
    if found is not None and not (found and all(isinstance(x, int) and x >= 0 for x in found)):
        raise TiffError(f"field {tag} isn't of whole numbers")
    return found


def _form(data: bytes, tags: dict[int, tuple], e: str, most: int) -> Form:
    """A page's form, and its strips or tiles, each of which has ``most`` bytes of samples at most."""
    one = lambda tag, default=None: (_whole(tags, tag) or (default,))[0]
    width, height = one(WIDTH), one(HEIGHT)
    if not width or not height:
        raise TiffError("a page without size")
    samples, compression, predictor, planar, order = one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1), one(FILL_ORDER, 1)
    if not samples or planar not in (1, 2) or compression not in NAMES or order not in (1, 2):
        raise TiffError(f"{samples} samples in layout {planar}, compression {compression}, or order of bits {order}, aren't supported")
    bits = set(_whole(tags, BITS) or (1,))
    if len(bits) != 1 or not bits <= {1, 8, 16}:
        raise TiffError(f"{sorted(bits)} bits a sample aren't supported")
    (bits,) = bits
    tiled = TILE_OFFSETS in tags
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    offsets, counts = _whole(tags, TILE_OFFSETS if tiled else STRIP_OFFSETS), _whole(tags, TILE_COUNTS if tiled else STRIP_COUNTS)
    if offsets is None or counts is None or len(offsets) != len(counts):
        raise TiffError("no strips or tiles")
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not w or not h or (tiled and (w > 2 * width + 4096 or h > 2 * height + 4096)):
        raise TiffError(f"strips or tiles of {w} x {h}")
    if w * h * inner * max(1, bits // 8) > most:
        raise TiffError(f"a strip or tile of {w} x {h} x {inner} samples is too large")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes:
        raise TiffError("too few strips or tiles")

    def parts() -> Iterator[tuple[int, int, int, np.ndarray]]:
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * h, cell % across * w
            if offsets[k] + counts[k] > len(data):
                raise TiffError("a strip or tile lies outside the file")
            packed = data[offsets[k] : offsets[k] + counts[k]]
            part = _segment(packed.translate(_MIRRORED) if order == 2 else packed, h if tiled else min(h, height - y), w, inner, bits, compression, predictor, e)
            yield y, x, plane, part[: height - y, : width - x]

    return Form(width, height, samples, bits, NAMES[compression], tiled, predictor, parts())


def _page(data: bytes, tags: dict[int, tuple], e: str) -> Page:
    f = _form(data, tags, e, 2 * PAGE_BYTES)
    if f.width * f.height * f.samples * max(1, f.bits // 8) > PAGE_BYTES:
        raise TiffError(f"a page of {f.width} x {f.height} x {f.samples} samples is too large for a row")
    pixels = np.zeros((f.height, f.width, f.samples), np.uint16 if f.bits == 16 else np.uint8)
    for y, x, plane, part in f.parts:
        pixels[y : y + part.shape[0], x : x + part.shape[1], plane : plane + part.shape[2]] = part
    return Page(f.width, f.height, f.samples, f.bits, f.compression, f.tiled, f.predictor, pixels)


def _after(data: bytes, at: int, e: str) -> int:
    """Where the directory that follows is; 0: nowhere, or the directory is broken."""
    try:
        (count,) = struct.unpack_from(e + "H", data, at)
        return struct.unpack_from(e + "I", data, at + 2 + 12 * count)[0]
    except struct.error:
        return 0


def _chain(data: bytes, at: int, e: str) -> tuple[int, bool]:
    """(directories of the chain, each once, and whether it then returns to one of them), in constant memory: of two
    walkers, one marks time at powers of two until the other meets it; then both go at the loop's length apart."""
    power = length = 1
    slow, fast, n = at, _after(data, at, e) if at else 0, 1 if at else 0
    while fast and slow != fast:
        n += 1
        if power == length:
            slow, power, length = fast, power * 2, 0
        fast, length = _after(data, fast, e), length + 1
    if not fast:
        return n, False
    ahead, behind, before = at, at, 0
    for _ in range(length):
        ahead = _after(data, ahead, e)
    while ahead != behind:
        ahead, behind, before = _after(data, ahead, e), _after(data, behind, e), before + 1
    return before + length, True


def _directories(data: bytes) -> Iterator[tuple[dict[int, tuple], str] | str]:
    """Each directory's fields and the file's byte order, or a message on what breaks the chain."""
    try:
        e = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(e + "HI", data, 2)
        if magic != 42:
            raise TiffError("not a TIFF file")
    except (KeyError, struct.error, TiffError):
        yield "not a TIFF file"
        return
    n, returns = _chain(data, at, e)
    for _ in range(n):
        try:
            tags, at = _directory(data, at, e)
        except Exception as x:  # a file may be broken in any way; what can't be read is said in a row
            yield f"broken image directory: {x}"
            return
        yield tags, e
    if returns:
        yield "image directories form a loop"


def read(data: bytes) -> Iterator[Page | str]:
    """The pages in order, however many; a page that can't be read is a message, as is what breaks the chain."""
    for found in _directories(data):
        if isinstance(found, str):
            yield found
            continue
        try:
            page: Page | str = _page(data, *found)
        except Exception as x:
            page = f"broken page: {x}"
        yield page


def read_segments(data: bytes) -> Iterator[tuple[int, Form | None, tuple[int, int, int, np.ndarray] | str]]:
    """(page, form, a strip or tile or a message), one at a time, so that a page of any size can be read."""
    for n, found in enumerate(_directories(data)):
        if isinstance(found, str):
            yield n, None, found
            continue
        try:
            form = _form(data, *found, PAGE_BYTES)
            for part in form.parts:
                yield n, form, part
        except Exception as x:
            yield n, None, f"broken page: {x}"


def write(pages: list[dict], big_endian: bool = False) -> bytes:
    """A TIFF file of pages: {pixels: rows x width bytes, compression, predictor, tile (its width and height; None: strips)}."""
    e = ">" if big_endian else "<"
    out, link = bytearray((b"MM" if big_endian else b"II") + struct.pack(e + "HI", 42, 0)), 4
    for p in pages:
        a = p["pixels"]
        height, width = a.shape
        tile, parts = p["tile"], []
        if tile:
            w, h = tile
            full = np.zeros((-(-height // h) * h, -(-width // w) * w), np.uint8)
            full[:height, :width] = a
            parts = [full[y : y + h, x : x + w] for y in range(0, len(full), h) for x in range(0, full.shape[1], w)]
        else:
            parts = [a[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        places, sizes = [], []
        for part in parts:
            if p["predictor"] == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            raw = np.ascontiguousarray(part).tobytes()
            packed = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 4)}[p["compression"]](raw)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [p["compression"]]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [p["predictor"]])]
        fields += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_COUNTS, 4, sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{e}{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body
                body = struct.pack(e + "I", where)
            entries += struct.pack(e + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(e + "I", out, link, len(out))
        out += struct.pack(e + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(e + "I", 0)
    return bytes(out)


# The query's rotation: compression, predictor and layout of a page, by its content.
FORMS = ((DEFLATE, 1, None), (LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, TILE), (PACKBITS, 1, TILE))


def text_to_tiff(data: bytes) -> bytes:
    """The bytes, padded by 255 to a positive multiple of the page width, as the samples of grey pages."""
    padded = data + b"\xff" * (-len(data) % PAGE_WIDTH if data else PAGE_WIDTH)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, PAGE_WIDTH)
    pages = []
    for y in range(0, len(rows), PAGE_ROWS):
        a = rows[y : y + PAGE_ROWS]
        compression, predictor, tile = FORMS[zlib.crc32(a.tobytes()) % len(FORMS)]
        pages.append({"pixels": a, "compression": compression, "predictor": predictor, "tile": tile})
    return write(pages, big_endian=len(data) % 2 == 1)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
            data = to_bytes(text)
            media = text_to_tiff(data)
            pages = list(read(media))
            if broken := [p for p in pages if isinstance(p, str)]:
                raise TiffError(broken[0])
            payload = b"".join(p.pixels.tobytes() for p in pages)
            a = np.frombuffer(payload, np.uint8)
            kinds = ",".join(f"{p.compression}{'+diff' * (p.predictor == 2)}{'+tiles' * p.tiled}" for p in pages[:1])
            feature = f"pages={len(pages)};width={pages[0].width};height={sum(p.height for p in pages)};first={kinds};mean={a.mean():.4f};deviation={a.std():.4f}"
            rows.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame) -> DataFrame:
    """A row per row of docs: the text stored as a TIFF file and read back, in digests.

    Null texts count as empty, and an empty text's payload is one row of padding. Rows of repeated and of null ids have
    a file each; equal texts have equal files. A text of any length that a row can hold is one page. Other columns of
    docs aren't looked at. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


PAGES = "id long, page int, width int, height int, samples int, bits int, compression string, tiled boolean, predictor int, pixels binary, error string"


def _explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PAGES.split(", ")]
    held: list[tuple] = []
    size = 0
    for frame in frames:
        for key, content in zip(frame["id"], frame["content"], strict=True):
            found = ["no content"] if content is None else read(bytes(content))
            for n, p in enumerate(found):
                row = (key, n, *[None] * 8, p) if isinstance(p, str) else (key, n, p.width, p.height, p.samples, p.bits, p.compression, p.tiled, p.predictor, p.pixels.tobytes(), None)
                held.append(row)
                size += 0 if isinstance(p, str) else p.pixels.nbytes
                if size > BATCH_BYTES or len(held) >= 4096:
                    yield pd.DataFrame(held, columns=names).astype({"id": "Int64", **dict.fromkeys(names[2:6], "Int64"), "predictor": "Int64"})
                    held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype({"id": "Int64", **dict.fromkeys(names[2:6], "Int64"), "predictor": "Int64"})


SEGMENTS = "id long, page int, y long, x long, plane int, height int, width int, samples int, bits int, pixels binary, error string"


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    held: list[tuple] = []
    size = 0

    def passed() -> pd.DataFrame:
        return pd.DataFrame(held, columns=names).astype({"id": "Int64", **dict.fromkeys(names[2:9], "Int64")})

    for frame in frames:
        for key, content in zip(frame["id"], frame["content"], strict=True):
            for n, form, part in [(0, None, "no content")] if content is None else read_segments(bytes(content)):
                if isinstance(part, str):
                    held.append((key, n, *[None] * 8, part))
                else:
                    y, x, plane, a = part
                    held.append((key, n, y, x, plane, *a.shape, form.bits, np.ascontiguousarray(a).tobytes(), None))
                    size += a.nbytes
                if size > BATCH_BYTES or len(held) >= 4096:
                    yield passed()
                    held, size = [], 0
    if held:
        yield passed()


def segments(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """One row for each strip or tile of each page, at its first row and column: the way to pages that are too large for a row
    of pages(), as no page is held whole. Errors as there; a strip or tile of more than PAGE_BYTES is one."""
    prepare(files.sparkSession)
    return files.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content")).mapInPandas(_cut, SEGMENTS)


def pages(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """One row a page of each TIFF file: its form and samples, or an error. Null content: one row with an error. What is
    not a TIFF file, and broken pages, give a row with an error; the other pages of the file stay."""
    prepare(files.sparkSession)
    return files.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content")).mapInPandas(_explode, PAGES)

"""Column expressions: bits, distances, paths, CSV. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of images, matched exactly and case-sensitively.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit words differ."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of the words' Hamming distances; fingerprints must have as many words."""
    if len(a) != len(b):
        raise ValueError("fingerprints of different lengths have no distance")
    return reduce(lambda x, y: x + y, (hamming(x, y) for x, y in zip(a, b, strict=True)))


def array_distance(a: Column, b: Column) -> Column:
    """The same over array columns; raises on arrays of different sizes."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(F.raise_error(F.lit("fingerprints of different lengths have no distance")).cast("int"))


def pack_bits(flags: Column) -> Column:
    """A word from an array of 64 booleans, the first being the lowest bit."""
    return F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_word(vector: Column) -> Column:
    """Bit 63 - i says whether element i is above 0, for 64 elements."""
    return pack_bits(F.transform(F.reverse(vector), lambda x: x > 0))


def popcount(c: Column) -> Column:
    return F.bit_count(c).cast("int")


def clamp_byte(x: Column) -> Column:
    """Half up for positive numbers, cut to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), (x + 0.5).cast("long"))).cast("int")


def grey(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Luminosity of 16-bit premultiplied channels of 8-bit ones."""
    wide = lambda c: F.floor((c * 257 * a) / 255)
    return F.lit(0.299) * wide(r) + F.lit(0.587) * wide(g) + F.lit(0.114) * wide(b)


def extension(path: Column) -> Column:
    """From the last dot of the last part of a path; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def csv_field(c: Column) -> Column:
    """Quoted if it has a comma, quote or line end, or begins with a space."""
    return F.when(c.rlike(r'[,"\r\n]|^[ \t]') | (c == "\\."), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_row(fields: Column) -> Column:
    return F.array_join(F.transform(fields, csv_field), ",")


def group_dir(folder: str, group: Column) -> Column:
    return F.format_string(folder.replace("%", "%%") + "/group%d", group)


def band(words: list[Column], first: int, size: int) -> Column:
    """Bits first .. first + size - 1 of a fingerprint (bit 0 is the lowest of the first word), not over a word's end."""
    word = words[first // 64]
    return F.shiftrightunsigned(word, first % 64).bitwiseAND(F.lit((1 << size) - 1).cast("long")) if size < 64 else word

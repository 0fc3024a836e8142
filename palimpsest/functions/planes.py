"""Pixels whose channels are stored apart or multiplied by alpha, as joins and whole-number columns in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (columns, rows) of pixels that share one chroma sample, by the name of the ratio.
RATIOS = {"444": (1, 1), "422": (2, 1), "420": (2, 2), "440": (1, 2)}
# The conversion's factors, in units of 1 / 65536.
LUMA, RED_OF_CR, GREEN_OF_CB, GREEN_OF_CR, BLUE_OF_CB = 0x10101, 91881, 22554, 46802, 116130


def _byte(scaled: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(scaled, 16))).cast("int")


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue bytes of luma and chroma bytes."""
    luma, blue, red = y.cast("int") * LUMA, cb.cast("int") - 128, cr.cast("int") - 128
    return _byte(luma + RED_OF_CR * red), _byte(luma - GREEN_OF_CB * blue - GREEN_OF_CR * red), _byte(luma + BLUE_OF_CB * blue)


def joined_planes(luma: DataFrame, chroma: DataFrame, ratio: str) -> DataFrame:
    """(id, y, x, r, g, b) of luma (id, y, x, v) and chroma (id, y, x, cb, cr), of which one sample serves several pixels as
    it is, without smoothing. Rows of one image spread over many keys, so large images need no treatment of their own."""
    wide, high = RATIOS[ratio]
    at = luma.withColumns({"_y": F.expr(f"y div {high}"), "_x": F.expr(f"x div {wide}")})
    samples = chroma.select("id", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), "cb", "cr")
    return at.join(samples, ["id", "_y", "_x"]).select("id", "y", "x", *(c.alias(n) for c, n in zip(rgb(F.col("v"), F.col("cb"), F.col("cr")), "rgb", strict=True)))


def unpremultiplied(c: Column, alpha: Column) -> Column:
    """A byte that was multiplied by an alpha byte, divided by it; 0 where alpha is."""
    whole = F.call_function("div", c.cast("long") * 255, F.nullif(alpha.cast("long"), F.lit(0)))
    return F.coalesce(F.pmod(whole, F.lit(256)), F.lit(0)).cast("int")


def unpremultiplied_wide(c: Column, alpha: Column) -> Column:
    """The high byte of a 16-bit channel divided by its alpha, which counts as 0 or as full by its high byte alone."""
    high = F.shiftright(alpha, 8)
    whole = F.shiftright(F.call_function("div", c.cast("long") * 65535, F.nullif(alpha.cast("long"), F.lit(0))), 8)
    return F.when(high == 0, 0).when(high == 255, F.shiftright(c, 8)).otherwise(F.pmod(whole, F.lit(256))).cast("int")

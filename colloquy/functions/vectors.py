"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(vector: Column) -> Column:
    """Signed bytes: 127 x, halves rounded up, held within 127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5).cast("int"))).cast("tinyint"))


def dequantize(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / 127)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def packed(vector: Column) -> Column:
    """Signed bytes as base64 text in one line, for readers outside Spark."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))), "\r\n", "")


def unpacked(text: Column) -> Column:
    """The signed bytes of ``packed`` text."""
    digits = F.hex(F.unbase64(text))
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    signed = F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1), lambda k: F.when(byte(k) > 127, byte(k) - 256).otherwise(byte(k)).cast("tinyint"))
    return F.when(F.length(digits) > 0, signed).otherwise(F.array().cast("array<tinyint>"))

"""64-bit hashes of pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dhash(pixels: Column) -> Column:
    """From nine columns by eight rows of grey values, row by row: a bit for each pixel brighter
    than its left neighbour, the first the highest. The array is bound once, not found anew for each bit."""
    left = F.array(*[F.lit(9 * row + column) for row in range(8) for column in range(8)])
    bit = lambda p, i: F.when(F.get(p, i + 1) > F.get(p, i), F.expr("1L")).otherwise(F.expr("0L"))
    of = lambda p: F.aggregate(left, F.expr("0L"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(p, i)))
    return F.get(F.transform(F.array(pixels), of), 0)


def hex16(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def axis_box(points: Column) -> Column:
    """The box around an array of (x, y) points; all 0 where there is none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return F.struct(zero(F.array_min(xs)).alias("x1"), zero(F.array_min(ys)).alias("y1"), zero(F.array_max(xs)).alias("x2"), zero(F.array_max(ys)).alias("y2"))

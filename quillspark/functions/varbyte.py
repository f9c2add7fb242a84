"""Variable-byte codes: seven bits a byte, low bits first, the high bit set on all bytes but the last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(value: Column) -> Column:
    """Bytes that an unsigned 32-bit value takes."""
    return reduce(lambda c, n: F.when(value < (1 << (7 * n)), F.lit(n)).otherwise(c), (4, 3, 2, 1), F.lit(5)).cast("int")


def total(values: Column) -> Column:
    """Bytes that an array of unsigned 32-bit values takes."""
    each = F.aggregate(values, F.lit(0), lambda s, v: s + size(v))
    return F.when(F.array_max(values) < 128, F.size(values)).otherwise(each)


def encode(values: Column) -> Column:
    """Bytes of an array of unsigned 32-bit values."""

    def one(v: Column) -> Column:
        part = lambda i, n: F.shiftleft(F.shiftright(v, 7 * i).bitwiseAND(F.lit(127).cast("long")).bitwiseOR(F.lit(128 if i < n - 1 else 0).cast("long")), 8 * (n - 1 - i))
        digits = lambda n: F.hex(reduce(lambda a, b: a.bitwiseOR(b), (part(i, n) for i in range(n))))
        longer = reduce(lambda c, n: F.when(v < (1 << (7 * n)), digits(n)).otherwise(c), (4, 3, 2), digits(5))
        return F.when(v < 128, F.substr(F.hex(v + 256), F.lit(2))).otherwise(longer)

    return F.unhex(F.array_join(F.transform(values, lambda v: one(v.cast("long"))), ""))


def decode(code: Column) -> Column:
    """The values of a code; a last value without its end is dropped."""

    def one(digits: Column) -> Column:
        number, n = F.conv(digits, 16, 10).cast("long"), F.length(digits)
        seven = lambda i, size: F.shiftleft(F.shiftright(number, 8 * (size - 1 - i)).bitwiseAND(F.lit(127).cast("long")), 7 * i)
        whole = lambda size: reduce(lambda a, b: a.bitwiseOR(b), (seven(i, size) for i in range(size)))
        longer = reduce(lambda c, size: F.when(n == 2 * size, whole(size)).otherwise(c), (4, 3, 2), whole(5))
        return F.when(n == 2, number).otherwise(longer)

    return F.transform(F.regexp_extract_all(F.hex(code), F.lit("\\G(?:[89A-F].)*+[0-7]."), F.lit(0)), one)

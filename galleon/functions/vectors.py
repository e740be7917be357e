"""Vector arithmetic on array columns, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; null if either side is null, has a null element, or the lengths differ."""
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a side has length zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    """Places whose signs differ, as a double."""
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: F.when(F.signum(x) != F.signum(y), 1.0).otherwise(0.0)))


def sign_code(a: Column, bits: int) -> Column:
    """The signs of the first ``bits`` elements as an integer: bit i is set where element i is above zero."""
    bit = F.transform(F.slice(a, 1, bits), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i.cast("double"))).otherwise(0.0))
    return _total(bit).cast("long")

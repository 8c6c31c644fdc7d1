"""Arithmetic on ARRAY columns and 64-bit hashes, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(values: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def unit(values: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""

    def scaled(length: Column) -> Column:
        return F.transform(values, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))

    # the length as the one element of an array: within the inner lambda it would be summed up per element
    return F.get(F.transform(F.array(norm(values)), scaled), F.lit(0))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    scale = total(shifted)
    return F.transform(shifted, lambda x: x / scale)


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pack_bits(values: Column, bit: Callable[[Column], Column]) -> Column:
    """BIGINT whose bit i says whether ``bit`` holds for element i (63 elements at most)."""
    flagged = F.transform(
        values, lambda x, i: F.when(bit(x), F.expr("1L") * _power(i)).otherwise(F.lit(0).cast("long"))
    )
    return F.aggregate(flagged, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _power(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def hex_to_bits(text: Column) -> Column:
    """BIGINT bit pattern of a 16-digit hex string."""
    return F.conv(text, 16, -10).cast("bigint")


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))

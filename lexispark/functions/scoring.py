"""BM25 in single precision.  A quotient of two floats is a double in Spark, and is cast back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Lengths below are kept as they are, above in a float of four significant bits.
EXACT = 24


def _float(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def _spare_bits(length: Column) -> Column:
    return F.length(F.bin(length - EXACT)) - 4


def quantized_length(length: Column) -> Column:
    """The length that scoring sees: exact below 40, then rounded down to four significant bits above EXACT."""
    bits = _spare_bits(length)
    kept = F.call_function("shiftleft", F.call_function("shiftright", length - EXACT, bits), bits)
    return F.when(length < 40, length).otherwise(kept + EXACT)


def length_norm(length: Column) -> Column:
    """The same as a byte from 0 to 255."""
    over, bits = length - EXACT, _spare_bits(length)
    coded = F.call_function("shiftright", over, bits).bitwiseAND(F.lit(7)).bitwiseOR(F.shiftleft(bits + 1, 3))
    return F.when(length < EXACT + 8, length).otherwise(coded + EXACT)


def decoded_length(norm: Column) -> Column:
    """The quantized length that a byte of length_norm() stands for."""
    over = norm.cast("int") - EXACT
    coded = F.call_function("shiftleft", over.bitwiseAND(F.lit(7)).bitwiseOR(F.lit(8)), F.shiftright(over, 3) - 1) + EXACT
    return F.when(norm < EXACT + 8, norm.cast("int")).otherwise(coded)


def average_length(tokens: Column, docs: Column) -> Column:
    return (tokens / F.greatest(docs, F.lit(1)).cast("double")).cast("float")


def idf(docs: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (docs - df + F.lit(0.5)) / (df + F.lit(0.5))).cast("float")


def norm_inverse(length: Column, average: Column) -> Column:
    """1 / (k1 * (1 - b + b * length / average)) of a quantized length."""
    share = (_float(B) * _float(length) / average).cast("float")
    return (_float(1) / (_float(K1) * (_float(1 - B) + share))).cast("float")


def bm25(weight: Column, tf: Column, inverse: Column) -> Column:
    return weight - (weight / (_float(1) + _float(tf) * inverse)).cast("float")

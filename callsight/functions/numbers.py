"""Number formatting with Python's rounding, as column expressions.

Python's ``f"{x:.2f}"`` rounds the exact binary value of ``x`` (half to even
on an exact tie); Java's ``%.2f`` rounds the shortest decimal form half up,
so 0.125 prints as 0.13 in Java and 0.12 in Python. ``py_fixed`` decides the
last digit on the exact value: ``p = x·10^d`` rounded, plus the exact error
of that product (Dekker's split, plain double arithmetic), then formats the
already-rounded number, where Java's rule can no longer disagree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1: splits a double into two halves whose products with 10^d are exact


def py_fixed(x: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` for a double column (null stays null); ``digits`` from 0 to 6."""
    scale = float(10**digits)
    p = x * scale
    c = x * _SPLIT
    hi = c - (c - x)
    lo = x - hi
    err = (hi * scale - p) + lo * scale  # p + err == x·10^d exactly
    q = F.floor(p)
    frac = p - q
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (q % 2 != 0))))
    rounded = (q + up.cast("bigint")) / scale
    negative = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))  # -0.0 keeps its sign, as in Python
    signed = F.when(negative & (rounded == 0), F.lit(-0.0)).otherwise(rounded)
    finite = F.format_string(f"%.{digits}f", signed)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))  # Java would print a null as "nu"
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(finite)
    )

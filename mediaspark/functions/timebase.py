"""Exact time arithmetic on integer ticks and rationals (column expressions)."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDINGS = ("zero", "inf", "down", "up", "near")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _dec(x) -> Column:
    return _col(x).cast("decimal(19,0)")


def _idiv(num: Column, den: Column) -> Column:
    """Truncating division of wide decimals."""
    return F.call_function("div", num, den)


def rescale(a, b, c, mode: str = "near") -> Column:
    """``a * b / c`` with a 128-bit safe product and a chosen rounding."""
    if mode not in ROUNDINGS:
        raise ValueError(f"mode must be one of {ROUNDINGS}")
    prod = (_dec(a) * _dec(b)).cast("decimal(38,0)")
    c = _dec(c)
    mag = F.abs(prod)
    low = _idiv(mag, c)
    high = _idiv(mag + c - F.lit(1), c)
    near = _idiv(mag + F.floor(c / F.lit(2)), c)
    sign = F.when(prod < 0, F.lit(-1)).otherwise(F.lit(1))
    if mode == "zero":
        return sign * low
    if mode == "inf":
        return sign * high
    if mode == "near":
        return sign * near
    if mode == "down":
        return F.when(prod < 0, -high).otherwise(low)
    return F.when(prod < 0, -low).otherwise(high)


def rescale_q(a, from_num, from_den, to_num, to_den, mode: str = "near") -> Column:
    """Ticks of one time base as ticks of another."""
    return rescale(
        a, _col(from_num).cast("bigint") * _col(to_den), _col(from_den).cast("bigint") * _col(to_num), mode
    )


def compare_ts(a, a_num, a_den, b, b_num, b_den) -> Column:
    """-1, 0 or 1: order of two times in different time bases, exact."""
    left = (_dec(a) * (_col(a_num).cast("bigint") * _col(b_den)).cast("decimal(19,0)")).cast("decimal(38,0)")
    right = (_dec(b) * (_col(b_num).cast("bigint") * _col(a_den)).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def wrap_diff(later, earlier, bits: int) -> Column:
    """Difference on a counter that wraps at ``2**bits``."""
    d = _col(later) - _col(earlier)
    return F.when(d < 0, d + F.lit(1 << bits)).otherwise(d)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two BIGINT columns.

    Euclid's steps run as a fold over a fixed list; 92 steps are enough for any
    pair of 64-bit values.
    """
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(
        s["y"] != 0, F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def rational(num, den) -> Column:
    return F.struct(_col(num).cast("bigint").alias("num"), _col(den).cast("bigint").alias("den"))


def reduce_q(q: Column) -> Column:
    """Lowest terms with a positive denominator."""
    g = gcd(q["num"], q["den"])
    sign = F.when(q["den"] < 0, F.lit(-1)).otherwise(F.lit(1))
    return rational(
        F.call_function("div", q["num"] * sign, g), F.call_function("div", q["den"] * sign, g)
    )


def add_q(a: Column, b: Column) -> Column:
    return reduce_q(rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"]))


def sub_q(a: Column, b: Column) -> Column:
    return reduce_q(rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"]))


def mul_q(a: Column, b: Column) -> Column:
    return reduce_q(rational(a["num"] * b["num"], a["den"] * b["den"]))


def div_q(a: Column, b: Column) -> Column:
    return reduce_q(rational(a["num"] * b["den"], a["den"] * b["num"]))


def double_to_q(x: Column, max_den: int) -> Column:
    """Nearest-first rational of a double, denominator at most ``max_den``."""

    @F.pandas_udf("num bigint, den bigint")
    def convert(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            if v is None or math.isnan(v):
                rows.append((0, 0))
            elif math.isinf(v):
                rows.append((1 if v > 0 else -1, 0))
            else:
                f = Fraction(v).limit_denominator(max_den)
                rows.append((f.numerator, f.denominator))
        return pd.DataFrame(rows, columns=["num", "den"])

    return convert(x)

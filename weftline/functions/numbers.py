"""Arithmetic that must agree with Python's to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a share whose sums are exact: shares of up to four decimals count in ten-thousandths.
UNITS = 10_000
#: Splits a double into two halves of 26 bits, whose products are exact.
_HALVES = float(2**27 + 1)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def round2(x: Column) -> Column:
    """x to two decimals as Python rounds: by its exact binary value, and half to even where that is a tie.

    200 x is p + e exactly, e being the product's error; it is compared with the odd integer between two hundredths.
    """

    def of(v: Column) -> Column:
        p, c = v * 200.0, v * _HALVES
        high = c - (c - v)
        error = (high * 200.0 - p) + (v - high) * 200.0
        k = F.floor(p / 2.0)
        up = (p > 2.0 * k + 1.0) | ((p == 2.0 * k + 1.0) & ((error > 0) | ((error == 0) & (F.abs(k % 2) == 1))))
        return F.when(F.isnan(v), v).otherwise((k + up.cast("long")) / 100.0)

    return let(x, of)


def round2_sql(x: str) -> str:
    """SQL for round2 of a column."""
    p, c = f"({x} * 200e0)", f"({x} * {_HALVES!r}::DOUBLE)"
    high = f"({c} - ({c} - {x}))"
    error = f"(({high} * 200e0 - {p}) + ({x} - {high}) * 200e0)"
    k = f"floor({p} / 2e0)"
    return f"((CASE WHEN {p} > 2e0 * {k} + 1e0 OR ({p} = 2e0 * {k} + 1e0 AND ({error} > 0 OR ({error} = 0 AND abs({k} % 2) = 1))) THEN {k} + 1 ELSE {k} END) / 100e0)"


def units(share: Column) -> Column:
    return F.round(share * UNITS).cast("decimal(18,0)")


def units_sql(share: str) -> str:
    return f"CAST(round({share} * {UNITS}) AS HUGEINT)"


def mean_of(s1: Column, n: Column) -> Column:
    """The mean from the sum of units; 0 for none."""
    return s1.cast("double") / (F.greatest(n, F.lit(1)) * float(UNITS))


def variance_of(s1: Column, s2: Column, n: Column) -> Column:
    """The population variance from the sums of units and their squares: one rounding, by the division."""
    own = F.greatest(n, F.lit(1)).cast("double")
    return (n * s2 - s1 * s1).cast("double") / (own * own * float(UNITS * UNITS))

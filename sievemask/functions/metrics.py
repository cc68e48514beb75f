"""Ratios over counts, and their display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"


def ratio(part: Column, whole: Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def _fixed(value: Column, places: int) -> Column:
    """A non-negative double with `places` (at most 2) decimals, rounded half-even on its exact binary value.

    The fraction is taken as a whole number of 2^-56ths, which is exact wherever a tie can occur; the engine's own
    formatting rounds the shortest decimal text instead and differs on values such as 0.35."""
    unit, ten = 1 << 56, 10**places
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(unit))).cast("long") * F.lit(ten)
    digits, rest = F.shiftright(scaled, 56), scaled.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & (digits % 2 == 1))
    total = whole * ten + digits + up.cast("long")
    return F.concat(
        F.floor(total / ten).cast("string"), F.lit("."), F.lpad((total % ten).cast("string"), places, "0")
    )


def percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(DASH)).otherwise(_fixed(value * 100, 1))


def milliseconds(ns: Column) -> Column:
    return F.when(ns.isNull(), F.lit(DASH)).otherwise(_fixed(ns / F.lit(1e6), 2))

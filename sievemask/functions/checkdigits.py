"""Check digits of Indian identifiers and payment cards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff multiplication, permutation and inverse tables, and the GSTIN alphabet.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
VERHOEFF_INVERSE = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DIGITS = r"\A[0-9]+\z"


def _table(rows) -> Column:
    """A two-dimensional table as one array constant, row after row; folded when the query is optimized."""
    return F.split(F.lit(",".join(str(v) for row in rows for v in row)), ",").cast("array<int>")


def _from_right(digits: Column) -> Column:
    return F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")


def _verhoeff_state(digits: Column, first_position: int) -> Column:
    d, p = _table(VERHOEFF_D), _table(VERHOEFF_P)
    permuted = F.transform(
        _from_right(digits),
        lambda c, i: F.element_at(p, (i + first_position) % 8 * 10 + c.cast("int") + 1),
    )
    return F.aggregate(permuted, F.lit(0), lambda state, v: F.element_at(d, state * 10 + v + 1))


def verhoeff_is_valid(digits: Column) -> Column:
    return F.when(digits.rlike(DIGITS), _verhoeff_state(digits, 0) == 0).otherwise(F.lit(False))


def verhoeff_check_digit(digits: Column) -> Column:
    """The digit to append to `digits`; null when it holds anything but ASCII digits."""
    inverse = _table([VERHOEFF_INVERSE])
    return F.when(digits.rlike(DIGITS), F.element_at(inverse, _verhoeff_state(digits, 1) + 1))


def luhn_is_valid(digits: Column) -> Column:
    return F.when(digits.rlike(DIGITS), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def luhn_check_digit(digits: Column) -> Column:
    def weighted(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when(i % 2 == 1, c.cast("int")).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(_from_right(digits), weighted), F.lit(0), lambda a, v: a + v)
    return F.when(digits.rlike(DIGITS), F.pmod(-total, F.lit(10)))


def gstin_check_char(body: Column) -> Column:
    """Mod-36 check character of a GSTIN body; null when a character is outside 0-9A-Z."""
    alphabet = F.lit(GSTIN_ALPHABET)

    def folded(c: Column, i: Column) -> Column:
        product = (F.position(c, alphabet) - 1) * F.when(i % 2 == 1, 2).otherwise(1)
        # At most 70, so its base-36 digit sum is either itself or one carry.
        return F.when(product >= 36, product - 35).otherwise(product)

    chars = F.filter(F.split(body, ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, folded), F.lit(0), lambda a, v: a + v)
    return F.when(
        body.rlike(r"\A[0-9A-Z]*\z"), F.substring(alphabet, F.pmod(-total, F.lit(36)) + 1, F.lit(1))
    )

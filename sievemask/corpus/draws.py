"""Seeded draws as column expressions.

A draw is a function of a key (seed, template, index, part, name) and nothing else: no state, no order, so any
task can make any sample, and editing one template never changes another's samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sample_key(seed: Column | int, template_id: Column, n: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat_ws("/", seed.cast("string"), template_id, n.cast("string"))


def let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` over a struct of `fields` that is computed once per row instead of at every mention."""
    bound = F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.element_at(F.transform(bound, body), 1)


def digest(key: Column, name: str) -> Column:
    return F.sha2(F.concat(key, F.lit("/" + name)), 256)


def number(hexes: Column, at: int, width: int) -> Column:
    """`width` hex digits (at most 15) of a digest from 1-based `at`, as a whole number."""
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long")


def below(key: Column, name: str, n: int | Column) -> Column:
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(number(digest(key, name), 1, 8), bound).cast("int")


def between(key: Column, name: str, low: int, high: int) -> Column:
    return below(key, name, high - low + 1) + low


def words(items: Sequence[str]) -> Column:
    """A list of strings as one array constant; folded when the query is optimized, and one expression until then."""
    return F.split(F.lit("\n".join(items)), "\n")


def pick(key: Column, name: str, items: Sequence[str]) -> Column:
    return F.element_at(words(items), below(key, name, len(items)) + 1)


def chance(hexes: Column, at: int, percent: int) -> Column:
    """True for `percent` of a hundred, on four hex digits of a digest."""
    return F.pmod(number(hexes, at, 4), F.lit(100)) < percent


def digits(key: Column, name: str, n: int) -> Column:
    """`n` (at most 11) decimal digits."""
    return F.lpad(F.pmod(number(digest(key, name), 1, 15), F.lit(10**n)).cast("string"), n, "0")


def letters(key: Column, name: str, n: int, alphabet: str = UPPER) -> Column:
    hexes = digest(key, name)
    return F.concat(
        *[
            F.substring(F.lit(alphabet), (F.pmod(number(hexes, 1 + 4 * i, 4), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
            for i in range(n)
        ]
    )

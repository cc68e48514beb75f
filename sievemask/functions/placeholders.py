"""The anatomy of a placeholder, and the ways language models bend it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_FRAGMENT = 3
_ANATOMY = r"(?s)\A([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)\z"


def opening(p: Column) -> Column:
    return F.regexp_extract(p, _ANATOMY, 1)


def inner(p: Column) -> Column:
    """From the first to the last letter or digit; empty when there is none."""
    return F.regexp_extract(p, _ANATOMY, 2)


def closing(p: Column) -> Column:
    return F.regexp_extract(p, _ANATOMY, 3)


def mangled(p: Column, mangle: Column) -> Column:
    """The placeholder as a model might copy it; unchanged when `mangle` is null."""
    spaced = F.concat(F.lit(" "), inner(p), F.lit(" "))
    return (
        F.when(mangle == "lowercase", F.lower(p))
        .when(mangle == "uppercase", F.upper(p))
        .when(mangle == "strip_delimiters", inner(p))
        .when(mangle == "space_padded", F.concat(opening(p), spaced, closing(p)))
        .otherwise(p)
    )


def fragments(p: Column) -> Column:
    """Lower-case pieces that betray a placeholder: all of it, its core, its halves; too short ones left out."""
    low = F.lower(p)
    size = F.length(low)
    half = F.floor((size + 1) / 2).cast("int")
    pieces = F.array(low, inner(low), F.substring(low, F.lit(1), half), F.substring(low, size - half + 1, half))
    return F.filter(
        F.array_distinct(pieces), lambda f: (F.length(f) >= MIN_FRAGMENT) & f.rlike(r"[\p{L}\p{N}]")
    )

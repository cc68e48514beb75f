"""Plain text columns: grouping, alphanumeric cores, excerpts, offset units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a regex class body (the engine's `\s` is ASCII only).
SPACE = r"\s\p{Z}\x1c-\x1f\x85"


def ungrouped(s: Column) -> Column:
    return F.translate(s, " -", "")


def group_by_four(s: Column, separator: Column | str) -> Column:
    sep = separator if isinstance(separator, Column) else F.lit(separator)
    return F.regexp_replace(s, F.lit("(.{4})(?=.)"), F.concat(F.lit("$1"), sep))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def ascii_digits(s: Column) -> Column:
    """The digits as ints, `[]` for an empty string, null when anything else is in it."""
    return F.when(s.rlike(r"\A[0-9]*\z"), F.transform(characters(s), lambda c: c.cast("int")))


def is_blank(s: Column) -> Column:
    return s.rlike(rf"\A[{SPACE}]*\z")


def has_edge_space(s: Column) -> Column:
    return s.rlike(rf"\A[{SPACE}]|[{SPACE}]\z")


def alnum_folded(s: Column) -> Column:
    """Letters and digits only, lower-cased: what survives when separators are dropped."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def excerpt(s: Column, limit: int = 600) -> Column:
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit), F.lit("…")))


def quoted(s: Column) -> Column:
    """The string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.array(s)), r"(?s)\A\[(.*)\]\z", 1)


def code_point_offset(text: Column, utf16_offset: Column) -> Column:
    """Turns an offset counted in UTF-16 units into one counted in code points.

    Each character above U+FFFF takes two units, so walking the text once and counting units is enough; texts
    without such characters keep their offsets and skip the walk."""
    walked = F.aggregate(
        characters(text),
        F.struct(F.lit(0).alias("units"), F.lit(0).alias("points")),
        lambda acc, c: F.when(acc["units"] >= utf16_offset, acc).otherwise(
            F.struct(
                (acc["units"] + F.when(F.ascii(c) > 65535, 2).otherwise(1)).alias("units"),
                (acc["points"] + 1).alias("points"),
            )
        ),
        lambda acc: acc["points"],
    )
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), walked).otherwise(
        F.least(utf16_offset, F.length(text))
    )


def slice_span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)

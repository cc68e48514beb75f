"""JSON kept as text: does it parse, is it equal, which strings does it hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# String literals of JSON text. The loops give nothing back, so the matcher walks them without recursion and a literal
# may have any length.
_INNER = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING_OR_KEY = rf'"{_INNER}"'
# The first alternative eats keys, the second captures values.
_STRING_VALUES = rf'{_STRING_OR_KEY}\s*:|"({_INNER})"'


def _wrapped(s: Column) -> Column:
    """`s` as one member of an object, so that trailing text after a complete value breaks the parse."""
    return F.call_function("try_parse_json", F.concat(F.lit('{"v":'), s, F.lit(',"z":0}')))


def parses(s: Column) -> Column:
    v = _wrapped(s)
    keys = F.call_function("json_object_keys", F.call_function("to_json", v))
    return F.coalesce((F.size(keys) == 2) & F.array_contains(keys, "v") & F.array_contains(keys, "z"), F.lit(False))


def canonical(s: Column) -> Column:
    """A text two JSON values share exactly when they are equal: keys sorted, whole numbers without a fraction.

    String literals are matched first and put back as they are, so only numbers lose their `.0`."""
    text = F.to_json(F.call_function("try_parse_json", s))
    return F.regexp_replace(text, rf"({_STRING_OR_KEY})|(-?[0-9]+)\.0+(?![0-9Ee])", "$1$2")


def same_json(a: Column, b: Column) -> Column:
    """Equal as JSON when both parse (key order and white space do not count), equal as text otherwise."""
    both = parses(a) & parses(b)
    return F.when(a == b, F.lit(True)).when(both, canonical(a) == canonical(b)).otherwise(F.lit(False))


def string_values(body: Column) -> Column:
    """All string values at any depth (keys left out, empty strings left out), unescaped, in text order."""
    literals = F.filter(F.regexp_extract_all(body, F.lit(_STRING_VALUES), F.lit(1)), lambda s: s != "")
    quoted = F.transform(literals, lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    rebuilt = F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))
    return F.from_json(rebuilt, "array<string>")

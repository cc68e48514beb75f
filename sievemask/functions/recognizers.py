"""The twelve recognizers and the detection expression built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemask.functions.checkdigits import gstin_check_char, luhn_is_valid, verhoeff_is_valid
from sievemask.functions.spans import CANDIDATE, empty, pattern_spans, resolve_overlaps


# An e-mail address: its domain ends with the letters of the last label that begins with two. Labels are walked by
# loops that give nothing back (skip others, step over such a label while one more follows), so a domain may have any length.
_OTHER_LABELS = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+"
_EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
    rf"(?:{_OTHER_LABELS}\.[A-Za-z]{{2}}[A-Za-z0-9-]*+(?={_OTHER_LABELS}\.[A-Za-z]{{2}}))*+"
    rf"{_OTHER_LABELS}\.[A-Za-z]{{2,}}+"
)

# The pattern of each label, in the order that decides ties. Digits are Unicode decimal digits and word characters
# letters, numbers and the underscore (combining marks excluded), spelled out because the JVM's own classes differ.
PATTERNS = {
    "AADHAAR_VID": r"(?<!\p{Nd})\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}(?!\p{Nd})",
    "CARD": r"(?<!\p{Nd})\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}(?!\p{Nd})",
    "AADHAAR": r"(?<!\p{Nd})[2-9]\p{Nd}{3}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}(?!\p{Nd})",
    "PHONE": r"(?<![\p{L}\p{N}_+])(?:\+91[ -]?|0)?[6-9]\p{Nd}{4}[ -]?\p{Nd}{5}(?!\p{Nd})",
    "GSTIN": r"(?<![A-Za-z0-9])\p{Nd}{2}[A-Za-z]{5}\p{Nd}{4}[A-Za-z][1-9A-Za-z][Zz][0-9A-Za-z](?![A-Za-z0-9])",
    "PAN": r"(?<![A-Za-z0-9])[A-Za-z]{3}[PCHFATBLJGpchfatbljg][A-Za-z]\p{Nd}{4}[A-Za-z](?![A-Za-z0-9])",
    "IFSC": r"(?<![A-Za-z0-9])[A-Za-z]{4}0[A-Za-z0-9]{6}(?![A-Za-z0-9])",
    "EMAIL": _EMAIL,
    "UPI": r"[A-Za-z0-9._-]{2,256}@[A-Za-z]{2,64}(?![A-Za-z0-9-]|\.[A-Za-z0-9])",
    "PASSPORT": r"(?<![A-Za-z0-9])[A-PR-WYa-pr-wy][1-9]\p{Nd}{5}[1-9](?![A-Za-z0-9])",
    "VOTER_ID": r"(?<![A-Za-z0-9])[A-Za-z]{3}\p{Nd}{7}(?![A-Za-z0-9])",
    "VEHICLE": r"(?<![A-Za-z0-9])[A-Za-z]{2}[ -]?\p{Nd}{2}[ -]?[A-Za-z]{1,2}[ -]?\p{Nd}{4}(?![A-Za-z0-9])",
}
LABELS = tuple(PATTERNS)


def _digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def sums_by_verhoeff(s: Column) -> Column:
    return verhoeff_is_valid(_digits_of(s))


def sums_by_luhn(s: Column) -> Column:
    return luhn_is_valid(_digits_of(s))


def ends_with_check_char(s: Column) -> Column:
    """Whether the last of fifteen characters follows from the others."""
    t = F.upper(s)
    return F.coalesce(gstin_check_char(F.substring(t, 1, 14)) == F.substring(t, 15, 1), F.lit(False))


# What a match must pass besides its pattern.
CHECKS = {"AADHAAR_VID": sums_by_verhoeff, "AADHAAR": sums_by_verhoeff, "CARD": sums_by_luhn, "GSTIN": ends_with_check_char}

# Which entity type each recognizer label stands for.
LABEL_ENTITY = {
    "AADHAAR_VID": "AADHAAR_VID",
    "CARD": "PAYMENT_CARD",
    "AADHAAR": "AADHAAR",
    "PHONE": "PHONE",
    "GSTIN": "GSTIN",
    "PAN": "PAN",
    "IFSC": "IFSC",
    "EMAIL": "EMAIL",
    "UPI": "UPI_ID",
    "PASSPORT": "PASSPORT",
    "VOTER_ID": "VOTER_ID",
    "VEHICLE": "VEHICLE_REGISTRATION",
}


# Cheap conditions that every match of the recognizers below them implies. A text is scanned with a recognizer's
# own pattern only when its condition holds, so ordinary prose costs a few plain scans instead of eleven.
_NUMBERS = r"\p{Nd}{4}"
_LONG_NUMBERS = r"\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}"
_TEN_DIGITS = r"\p{Nd}{5}[ -]?\p{Nd}{5}"
_LETTER_NUMBERS = r"[A-Za-z]\p{Nd}{4}"
_PLATE_TAIL = r"\p{Nd}[ -]?[A-Za-z]{1,2}[ -]?\p{Nd}{4}"
_IFSC_HEAD = r"[A-Za-z]{4}0"


def _found_by(text: Column, *labels: str) -> Column:
    """Candidates of recognizers that share one pattern; the text is cut once for all of them."""

    def labelled(x: Column) -> Column:
        options = []
        for label in labels:
            rank = F.lit(LABELS.index(label)).alias("rank")
            one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), rank, F.lit(label).alias("label"), x["value"].alias("value")))
            options.append(F.when(CHECKS[label](x["value"]), one).otherwise(empty(CANDIDATE)) if label in CHECKS else one)
        return F.concat(*options)

    return F.flatten(F.transform(pattern_spans(text, PATTERNS[labels[0]]), labelled))


def _if(condition: Column, *found: Column) -> Column:
    return F.when(condition, F.concat(*found) if len(found) > 1 else found[0]).otherwise(empty(CANDIDATE))


def candidates(text: Column) -> Column:
    """Every match that passes its check, before overlaps are resolved."""
    numbers = _if(
        text.rlike(_NUMBERS),
        _if(text.rlike(_LONG_NUMBERS), _found_by(text, "AADHAAR_VID", "CARD"), _found_by(text, "AADHAAR")),
        _if(text.rlike(_TEN_DIGITS), _found_by(text, "PHONE")),
        _if(
            text.rlike(_LETTER_NUMBERS),
            _found_by(text, "GSTIN"), _found_by(text, "PAN"), _found_by(text, "PASSPORT"), _found_by(text, "VOTER_ID"),
        ),
        _if(text.rlike(_PLATE_TAIL), _found_by(text, "VEHICLE")),
    )
    handles = _if(F.contains(text, F.lit("@")), _found_by(text, "EMAIL"), _found_by(text, "UPI"))
    return F.concat(numbers, _if(text.rlike(_IFSC_HEAD), _found_by(text, "IFSC")), handles)


def may_hold(text: Column) -> Column:
    """True for every text `detect` finds something in, and cheap: used to keep other texts out of shuffles."""
    return F.contains(text, F.lit("@")) | text.rlike(rf"{_NUMBERS}|{_IFSC_HEAD}")


def detect(text: Column) -> Column:
    """`array<struct<start,end,label,value>>` of the spans found in `text`, in order and disjoint."""
    return F.transform(
        resolve_overlaps(candidates(text)),
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["label"].alias("label"), c["value"].alias("value")
        ),
    )

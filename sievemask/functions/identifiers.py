"""Structural validators: whole-string predicates, one per identifier type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemask.functions.checkdigits import gstin_check_char, luhn_is_valid, verhoeff_is_valid
from sievemask.functions.text import SPACE, ungrouped

# GST state codes, PAN holder types, passport series letters.
GST_STATES = (
    "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13", "14", "15", "16", "17", "18",
    "19", "20", "21", "22", "23", "24", "26", "27", "29", "30", "32", "33", "34", "35", "36", "37", "38", "97",
)
PAN_HOLDERS = "PCHFATBLJG"
PASSPORT_SERIES = "ABCDEFGHIJKLMNOPRSTUVWY"

PAN_SHAPE = rf"[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]"


def is_aadhaar(s: Column) -> Column:
    d = ungrouped(s)
    return F.when(d.rlike(r"\A[2-9][0-9]{11}\z"), verhoeff_is_valid(d)).otherwise(F.lit(False))


def is_vid(s: Column) -> Column:
    d = ungrouped(s)
    return F.when(d.rlike(r"\A[0-9]{16}\z"), verhoeff_is_valid(d)).otherwise(F.lit(False))


def is_pan(s: Column) -> Column:
    return F.upper(s).rlike(rf"\A{PAN_SHAPE}\z")


def is_gstin(s: Column) -> Column:
    t = F.upper(s)
    shape = rf"\A(?:{'|'.join(GST_STATES)}){PAN_SHAPE}[0-9A-Z]{{3}}\z"
    return F.when(
        t.rlike(shape), gstin_check_char(F.substring(t, 1, 14)) == F.substring(t, 15, 1)
    ).otherwise(F.lit(False))


def is_ifsc(s: Column) -> Column:
    return F.upper(s).rlike(r"\A[A-Z]{4}0[0-9A-Z]{6}\z")


def is_upi(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z0-9._-]{2,256}@[A-Za-z]{2,64}\z")


def is_phone(s: Column) -> Column:
    return ungrouped(s).rlike(r"\A(?:\+91|91|0)?[6-9][0-9]{9}\z")


def is_email(s: Column) -> Column:
    return s.rlike(rf"\A[^@{SPACE}]+@(?!\.)[A-Za-z0-9.-]*\.[A-Za-z0-9.-]*(?<!\.)\z")


def is_card(s: Column) -> Column:
    d = ungrouped(s)
    return F.when(d.rlike(r"\A[0-9]{13,19}\z"), luhn_is_valid(d)).otherwise(F.lit(False))


def is_passport(s: Column) -> Column:
    return F.upper(s).rlike(rf"\A[{PASSPORT_SERIES}][1-9][0-9]{{5}}[1-9]\z")


def is_voter_id(s: Column) -> Column:
    return F.upper(s).rlike(r"\A[A-Z]{3}[0-9]{7}\z")


def is_vehicle(s: Column) -> Column:
    return F.upper(ungrouped(s)).rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}\z")


VALIDATORS = {
    "AADHAAR": is_aadhaar,
    "AADHAAR_VID": is_vid,
    "PAN": is_pan,
    "GSTIN": is_gstin,
    "IFSC": is_ifsc,
    "UPI_ID": is_upi,
    "PHONE": is_phone,
    "EMAIL": is_email,
    "PAYMENT_CARD": is_card,
    "PASSPORT": is_passport,
    "VOTER_ID": is_voter_id,
    "VEHICLE_REGISTRATION": is_vehicle,
}


def is_valid(entity: Column, s: Column) -> Column:
    """Dispatch on the entity name; null for types without a structural rule."""
    branches = None
    for name, rule in VALIDATORS.items():
        branches = F.when(entity == name, rule(s)) if branches is None else branches.when(entity == name, rule(s))
    return branches

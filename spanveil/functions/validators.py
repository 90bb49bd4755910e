"""Checks of candidates and names, as Boolean columns; never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SECRET_KINDS, SECRET_PARTS


def luhn_valid(v: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.translate(v, " -", "")), F.lit(False))


def aba_valid(v: Column) -> Column:
    total = sum((F.substring(v, i + 1, 1).cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return F.when(F.coalesce(v.rlike(r"^[0-9]{9}\z"), F.lit(False)), total % 10 == 0).otherwise(F.lit(False))


def ipv4_valid(v: Column) -> Column:
    return F.when(F.coalesce(v.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9}){3}\z"), F.lit(False)), F.forall(F.split(v, r"\."), lambda p: p.cast("int") <= 255)).otherwise(F.lit(False))


def ipv6_valid(v: Column) -> Column:
    """Of a run of groups and colons: two colons or a dotted tail, and a digit somewhere."""
    colons = F.length(v) - F.length(F.translate(v, ":", ""))
    return F.coalesce(((colons >= 2) | F.contains(v, F.lit("."))) & v.rlike("[0-9A-Fa-f]"), F.lit(False))


def iban_valid(v: Column) -> Column:
    bare = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(digit(c) > 9, (r * 100 + digit(c)) % 97).otherwise((r * 10 + digit(c)) % 97))
    return F.when(F.coalesce(bare.rlike(r"^[A-Z0-9]{15,34}\z"), F.lit(False)), rest == 1).otherwise(F.lit(False))


def jurisdiction_valid(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[A-Za-z]{2}\z"), F.lit(False))


def is_secret_kind(kind: Column) -> Column:
    low = F.lower(kind)
    return low.rlike("|".join(SECRET_PARTS)) | low.isin(*SECRET_KINDS)


def canonical_kind(kind: Column) -> Column:
    return F.replace(F.lower(F.trim(kind)), F.lit(" "), F.lit("_"))


# Fixed value: the placeholders' form.
PREFIX = "__DO_PRIVATE_"
PLACEHOLDER = PREFIX + "[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*__"
REDACTED = PREFIX + "REDACTED__"


def is_placeholder(v: Column) -> Column:
    return F.coalesce(v.rlike(rf"^{PLACEHOLDER}\z"), F.lit(False))


def is_minted(v: Column) -> Column:
    return F.coalesce(v.rlike(rf"^{PREFIX}[A-Za-z0-9]+(_[A-Za-z0-9]+)*_[0-9]+_[0-9A-Fa-f]{{16}}__\z"), F.lit(False))


def placeholder_kind_valid(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[A-Za-z0-9]+(_[A-Za-z0-9]+)*\z"), F.lit(False))

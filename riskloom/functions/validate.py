"""Checks of matched values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits that pass the mod-10 check."""
    own = digits(value)
    return F.length(own).between(13, 19) & F.call_function("luhn_check", own)


def resident_number_ok(value: Column) -> Column:
    """A 13-digit resident number: written with a hyphen it passes, else its mod-11 check digit must hold."""
    own = digits(value)
    weights = F.array(*[F.lit(w) for w in (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)])
    figure = lambda i: F.substring(own, i, F.lit(1)).cast("int")
    total = F.aggregate(F.zip_with(F.sequence(F.lit(1), F.lit(12)), weights, lambda i, w: figure(i) * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    check = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(10))
    return (F.length(own) == 13) & (value.contains("-") | (check == figure(F.lit(13))))


def not_self_named(match: Column) -> Column:
    """Of key = value, whether the value says more than the key's own name."""
    plain = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    key, value = F.regexp_extract(match, r"^([\w.-]+)\s*[:=]", 1), F.regexp_extract(match, r"[:=]\s*(.*)$", 1)
    return plain(key) != plain(value)


def private_address(value: Column) -> Column:
    """Whether an IPv4 address is one of the private ranges, with all parts below 256."""
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.forall(parts, lambda x: x.between(0, 255)) & ((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))


VALIDATORS = {"luhn": luhn_ok, "resident_number": resident_number_ok, "not_self_named": not_self_named, "private_address": private_address}

"""Checksums of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import JS_SPACE, PAN_HOLDERS

#: Multiplication in the dihedral group of order 10, and the position permutations.
_D5 = (
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
_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([_TURN[x] for x in rows[-1]])
    return rows


def digits_of(raw: Column) -> Column:
    """raw without white space and hyphens."""
    return F.regexp_replace(raw, rf"[{JS_SPACE}\-]", "")


def is_luhn(digits: Column) -> Column:
    """13 to 19 digits with a right Luhn checksum."""
    return F.when(digits.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def is_verhoeff(digits: Column) -> Column:
    """Exactly 12 digits with a right Verhoeff checksum."""
    times = F.lit([x for row in _D5 for x in row])
    turned = F.lit([x for row in _permutations() for x in row])
    digit = lambda i: F.substring(digits, 12 - i, F.lit(1)).cast("int")
    step = lambda c, i: F.get(times, c * 10 + F.get(turned, (i % 8) * 10 + digit(i)))
    return F.when(digits.rlike("^[0-9]{12}$"), F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0).otherwise(F.lit(False))


def passes(check: str | None, raw: Column) -> Column:
    """Whether a hit of a pattern passes the checksum that goes with it."""
    if check is None:
        return F.lit(True)
    digits = digits_of(raw)
    if check == "luhn":
        return is_luhn(digits)
    if check == "aadhaar":
        return is_verhoeff(digits) & digits.rlike("^[2-9]")
    return F.substring(raw, 4, 1).isin(*PAN_HOLDERS)

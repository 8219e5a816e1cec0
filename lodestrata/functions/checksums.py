"""Check-digit and range tests of identity numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digit weights of the official algorithms.
CPF_WEIGHTS = (list(range(10, 1, -1)), list(range(11, 1, -1)))
CNPJ_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def digits(text: Column) -> Column:
    """The ASCII digits of a text."""
    return F.regexp_replace(text, r"[^0-9]", "")


def _weighted(number: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.coalesce(F.substring(number, i + 1, 1).try_cast("int"), F.lit(0)) * w
    return total


def _mod11(number: Column, length: int, weights: tuple[list[int], list[int]]) -> Column:
    ok = (F.length(number) == length) & ~number.rlike(r"^(.)\1*$")
    for w in weights:
        rest = _weighted(number, w) % 11
        expected = F.when(rest < 2, 0).otherwise(11 - rest)
        ok = ok & (F.substring(number, len(w) + 1, 1).try_cast("int") == expected)
    return F.coalesce(ok, F.lit(False))


def cpf_valid(number: Column) -> Column:
    """Brazilian person number: 11 digits, two check digits, not all alike."""
    return _mod11(number, 11, CPF_WEIGHTS)


def cnpj_valid(number: Column) -> Column:
    """Brazilian company number: 14 digits, two check digits, not all alike."""
    return _mod11(number, 14, CNPJ_WEIGHTS)


def ssn_valid(text: Column) -> Column:
    """US number as written, three-two-four, without the ranges that are never issued."""
    area, group, serial = (F.regexp_extract(text, r"^(\d{3})-(\d{2})-(\d{4})$", i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), F.lit(False))


def luhn_valid(number: Column) -> Column:
    """Payment card number: 13 to 19 digits, Luhn check."""
    return F.coalesce(F.length(number).between(13, 19) & F.call_function("luhn_check", number), F.lit(False))


def cns_valid(number: Column) -> Column:
    """Brazilian health number: 15 digits; by first digit derived from an 11-digit base, or a plain sum."""
    first = F.substring(number, 1, 1)
    total = _weighted(number, list(range(15, 4, -1)))
    digit = (11 - total % 11) % 11
    again = (11 - (total + 2) % 11) % 11
    derived = F.when(digit == 10, F.concat(F.substring(number, 1, 11), F.lit("001"), again.cast("string"))).otherwise(F.concat(F.substring(number, 1, 11), F.lit("000"), digit.cast("string")))
    plain = _weighted(number, list(range(15, 0, -1))) % 11 == 0
    return F.coalesce((F.length(number) == 15) & F.when(first.isin("1", "2"), number == derived).when(first.isin("7", "8", "9"), plain).otherwise(False), F.lit(False))


VALIDATORS = {"cpf": lambda m: cpf_valid(digits(m)), "cnpj": lambda m: cnpj_valid(digits(m)), "ssn": ssn_valid, "luhn": lambda m: luhn_valid(digits(m)), "cns": lambda m: cns_valid(digits(m))}

"""Bits of 64-bit integers."""

from pyspark.sql import Column, functions as F

from .blanks import as_column
from .conversions import from_digits


def has_bit(value, index: int) -> Column:
    return F.getbit(as_column(value).cast("long"), F.lit(index)) == 1


def bit_count(value) -> Column:
    return F.bit_count(as_column(value).cast("long"))


def to_binary(value) -> Column:
    return F.bin(as_column(value))


def from_binary(text) -> Column:
    """The number in signed binary text; NULL for any other text."""
    return from_digits(text, 2, "[01]+")


def bit_and(a, b) -> Column:
    return as_column(a).bitwiseAND(as_column(b))


def bit_or(a, b) -> Column:
    return as_column(a).bitwiseOR(as_column(b))


def bit_xor(a, b) -> Column:
    return as_column(a).bitwiseXOR(as_column(b))


def shift_left(a, places: int) -> Column:
    return F.shiftleft(as_column(a), places)


def shift_right(a, places: int) -> Column:
    return F.shiftright(as_column(a), places)


def shift_right_unsigned(a, places: int) -> Column:
    return F.shiftrightunsigned(as_column(a), places)

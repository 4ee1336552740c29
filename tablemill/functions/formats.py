"""Numbers as text."""

from pyspark.sql import Column, functions as F

from .blanks import as_column, blank_to_null


def format_decimal(value, places_or_pattern) -> Column:
    """With a number of decimals (no leading zero, the point always shown) or a decimal pattern."""
    pattern = places_or_pattern
    if isinstance(pattern, int):
        pattern = "#." + "0" * pattern
    return F.call_function("format_number", blank_to_null(value), F.lit(pattern))


def format_decimal_local(value, places_or_pattern, point: str = ",", grouping: str = ".") -> Column:
    """Like :func:`format_decimal` with the decimal point and grouping mark of a locale."""
    return F.translate(format_decimal(value, places_or_pattern), ".,", point + grouping)

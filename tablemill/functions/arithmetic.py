"""Rounding, extremes, remainders, phases, logarithms and angles."""

from pyspark.sql import Column, functions as F

from .blanks import as_column, blank_to_null, is_blank


def round_up(x) -> Column:
    return F.ceil(blank_to_null(x))


def round_down(x) -> Column:
    return F.floor(blank_to_null(x))


def round_nearest(x) -> Column:
    """The nearest integer; of two equally near ones the even one."""
    return F.rint(blank_to_null(x)).try_cast("long")


def round_decimal(x, places: int) -> Column:
    """Rounded to ``places`` decimals, as a 32-bit float. Ties round away from zero."""
    return F.round(as_column(x), places).cast("float")


def absolute(x) -> Column:
    return F.abs(as_column(x))


def max_int(a, b) -> Column:
    """The greater of two integers; NULL if one is NULL."""
    a, b = as_column(a), as_column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def min_int(a, b) -> Column:
    a, b = as_column(a), as_column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def max_nan(a, b) -> Column:
    """The greater of two values; blank if either is blank."""
    return F.when(~is_blank(a) & ~is_blank(b), F.greatest(as_column(a), as_column(b)))


def min_nan(a, b) -> Column:
    return F.when(~is_blank(a) & ~is_blank(b), F.least(as_column(a), as_column(b)))


def max_real(a, b) -> Column:
    """The greater of two values, blanks ignored."""
    return F.greatest(blank_to_null(a), blank_to_null(b))


def min_real(a, b) -> Column:
    return F.least(blank_to_null(a), blank_to_null(b))


def mod(a, b) -> Column:
    """The remainder of a/b that is never negative; blank for b = 0."""
    a, b = as_column(a), F.abs(as_column(b))
    return F.when(b != 0, F.pmod(a, b))


def phase(t, period, t0=None, phase0=None) -> Column:
    """Phase of ``t - t0`` in ``period``, in [phase0, phase0 + 1)."""
    t, period = as_column(t).cast("double"), as_column(period).cast("double")
    if t0 is not None:
        t = t - as_column(t0)
    folded = F.when(period != 0, mod(t, period) / period)
    if phase0 is None:
        return folded
    phase0 = as_column(phase0)
    return phase0 + F.pmod(folded - phase0, F.lit(1.0))


def integer_division(a, b) -> Column:
    """Division of integers that drops the fraction; blank for b = 0."""
    b = as_column(b)
    return F.when(b != 0, F.call_function("div", as_column(a), b))


def divide(a, b) -> Column:
    """Division; blank for b = 0."""
    return F.try_divide(as_column(a), as_column(b))


def remainder(a, b) -> Column:
    """``a % b`` with the sign of ``a``; blank for b = 0."""
    b = as_column(b)
    return F.when(b != 0, as_column(a) % b)


def log10(x) -> Column:
    return F.log10(as_column(x))


def ln(x) -> Column:
    return F.ln(as_column(x))


def exp(x) -> Column:
    return F.exp(as_column(x))


def sqrt(x) -> Column:
    return F.sqrt(as_column(x))


def power(x, y) -> Column:
    return F.pow(as_column(x), as_column(y))


def sin(x) -> Column:
    return F.sin(as_column(x))


def cos(x) -> Column:
    return F.cos(as_column(x))


def tan(x) -> Column:
    return F.tan(as_column(x))


def atan2(y, x) -> Column:
    return F.atan2(as_column(y), as_column(x))


def hypot(x, y) -> Column:
    return F.hypot(as_column(x), as_column(y))


def to_radians(x) -> Column:
    return F.radians(as_column(x))


def to_degrees(x) -> Column:
    return F.degrees(as_column(x))


def boolean_xor(a, b) -> Column:
    return as_column(a) != as_column(b)

"""Blank values. A blank is NULL or, for floating point, NaN."""

from pyspark.sql import Column, functions as F, types as T


def as_column(value) -> Column:
    """A Column from a Column, a column name, or a number."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def blank_to_null(value) -> Column:
    """NaN becomes NULL, so that aggregates and comparisons skip it."""
    return F.nanvl(as_column(value).cast("double"), F.lit(None).cast("double"))


def is_blank(value) -> Column:
    """True for NULL and NaN (numeric columns)."""
    value = as_column(value)
    return value.isNull() | F.coalesce(F.isnan(value), F.lit(False))


def not_blank(value) -> Column:
    return ~is_blank(value)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def typed_blank_to_null(df, name: str) -> Column:
    """Like :func:`blank_to_null`, but leaves columns that cannot hold NaN as they are."""
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(F.col(name)), F.col(name))
    return F.col(name)

"""Between strings and numbers. What cannot be converted is blank, never an error."""

from pyspark.sql import Column, functions as F

from .blanks import as_column, blank_to_null

_INTEGER = r"(?<![\w.])[-+]?\d+(?![\w.])"
# Every text that is read as a whole number, as a double and as a decimal. A failed cast costs an exception, many times as much
# as looking at the text first; the cast itself decides in the end.
_WHOLE = r"^[^0-9A-Za-z+.-]*[-+]?[0-9]*\.?[0-9]*[^0-9A-Za-z+.-]*$"
_DOUBLE = (
    r"(?i)^[\x00-\x20]*[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?[fd]?"
    r"|0x(?:[0-9a-f]+\.?|[0-9a-f]*\.[0-9a-f]+)p[-+]?[0-9]+[fd]?|inf(?:inity)?|nan)[\x00-\x20]*$"
)
_DECIMAL = r"^[\x00-\x20]*[-+]?(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][-+]?\p{Nd}+)?[\x00-\x20]*$"
_REAL = r"(?i)(?<![\w.])(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?|nan)(?![\w.])"


def to_string(value) -> Column:
    return as_column(value).cast("string")


def parse_byte(text) -> Column:
    return _narrowed(parse_long(text), 8, "byte")


def parse_short(text) -> Column:
    return _narrowed(parse_long(text), 16, "short")


def parse_int(text) -> Column:
    return _narrowed(parse_long(text), 32, "int")


def parse_long(text) -> Column:
    return _if_like(text, _WHOLE, "long")


def parse_float(text) -> Column:
    return _if_like(text, _DOUBLE, "float")


def parse_double(text) -> Column:
    return _if_like(text, _DOUBLE, "double")


def parse_big_integer(text) -> Column:
    """At most 38 digits; longer numbers and numbers with a fraction are blank."""
    text = as_column(text)
    return F.when(text.rlike(r"^\s*[-+]?\d+\s*$"), text.try_cast("decimal(38,0)"))


def parse_big_decimal(text, scale: int = 10) -> Column:
    """At most 38 digits, ``scale`` of them after the point."""
    return _if_like(text, _DECIMAL, f"decimal(38,{scale})")


def _if_like(text, pattern: str, kind: str) -> Column:
    text = as_column(text)
    return F.when(text.cast("string").rlike(pattern), text.try_cast(kind))


def parse_ints(text) -> Column:
    """The integers that stand alone in a string; other words are ignored."""
    words = F.regexp_extract_all(as_column(text), F.lit(_INTEGER), F.lit(0))
    return F.transform(words, lambda w: w.try_cast("int"))


def parse_doubles(text) -> Column:
    """The numbers (NaN included) that stand alone in a string; other words are ignored."""
    words = F.regexp_extract_all(as_column(text), F.lit(_REAL), F.lit(0))
    return F.transform(words, lambda w: w.try_cast("double"))


def to_byte(value) -> Column:
    """The fraction is dropped; blank out of range."""
    return _if_in_range(value, 8, "byte")


def to_short(value) -> Column:
    return _if_in_range(value, 16, "short")


def to_integer(value) -> Column:
    return _if_in_range(value, 32, "int")


def to_long(value) -> Column:
    return _if_in_range(value, 64, "long")


def _if_in_range(value, bits: int, kind: str) -> Column:
    """The cast where the value, as a double, is near the range of this many bits; beyond it each cast would cost an exception."""
    value, half = blank_to_null(value), 2.0 ** (bits - 1)
    return F.when(value.between(-half - 1, half), value.try_cast(kind))


def _narrowed(whole: Column, bits: int, kind: str) -> Column:
    half = 1 << (bits - 1)
    return F.when(whole.between(-half, half - 1), whole.try_cast(kind))


def to_float(value) -> Column:
    """Blank out of the range of 32-bit floats."""
    narrow = as_column(value).try_cast("float")
    overflow = F.abs(narrow) == float("inf")
    return F.when(~overflow, narrow)


def to_double(value) -> Column:
    return as_column(value).cast("double")


def to_hex(value) -> Column:
    return F.lower(F.hex(as_column(value)))


def from_hex(text) -> Column:
    """The number in signed hexadecimal text; NULL for any other text."""
    return from_digits(text, 16, "[0-9a-fA-F]+")


def from_digits(text, base: int, digits: str) -> Column:
    text = as_column(text)
    size = F.conv(F.ltrim(text, F.lit("+-")), base, 10).try_cast("long")
    return F.when(text.rlike(rf"\A[+-]?{digits}\z"), F.when(F.startswith(text, F.lit("-")), -size).otherwise(size))


def has_type(df, name: str, type_name: str) -> Column:
    """Class membership of a column, known from the schema: a literal."""
    return F.lit(df.schema[name].dataType.simpleString() == type_name)

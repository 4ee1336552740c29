"""String functions."""

from pyspark.sql import Column, functions as F

from .blanks import as_column

# The characters that count as white space at the ends of a string, and the separators
# that end a line, as a regular expression.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def strip(value) -> Column:
    """Without white space of any kind (not only blanks, as in plain ``trim``) at both ends."""
    return strip_characters(value, SPACE)


def strip_characters(value, characters: str) -> Column:
    """Without any of the given characters at both ends."""
    return F.btrim(as_column(value), F.lit(characters))


def clean_lines(value) -> Column:
    """Every line stripped, empty lines dropped, joined with one line feed."""
    lines = F.transform(F.split(as_column(value), LINE_END), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def file_stem(name) -> Column:
    """A file name without its last extension (a leading dot starts no extension)."""
    base = F.regexp_replace(as_column(name), "^.*/", "")
    return F.regexp_replace(base, r"(?s)^(.*[^.].*)\.[^.]*$", "$1")


def file_safe(name) -> Column:
    """Every character that is neither letter nor digit replaced by an underscore."""
    return F.regexp_replace(as_column(name), r"[^\p{L}\p{N}]", "_")


def equals(a, b) -> Column:
    return as_column(a) == b


def starts_with(a, b) -> Column:
    return F.startswith(as_column(a), F.lit(b))


def ends_with(a, b) -> Column:
    return F.endswith(as_column(a), F.lit(b))


def contains(a, b) -> Column:
    return F.contains(as_column(a), F.lit(b))


def matches(value, pattern: str) -> Column:
    """True when the *whole* string matches."""
    return as_column(value).rlike(rf"\A(?:{pattern})\z")


def length(value) -> Column:
    return F.length(as_column(value))


def substring(value, start: int, end: int | None = None) -> Column:
    """Characters ``start`` (from 0) up to but without ``end``."""
    value = as_column(value)
    if end is None:
        return F.substr(value, F.lit(start + 1))
    return F.substr(value, F.lit(start + 1), F.lit(max(end - start, 0)))


def replace(value, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_column(value), pattern, replacement)


def split(value, pattern: str = r"\s+") -> Column:
    return F.split(as_column(value), pattern)


def join(words, separator: str) -> Column:
    return F.array_join(as_column(words), separator)


def concatenate(*parts) -> Column:
    """``+`` on strings: blanks give a blank."""
    return F.concat(*[as_column(p).cast("string") for p in parts])

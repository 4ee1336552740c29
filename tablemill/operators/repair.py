"""Repair of responses and extraction of the useful part of generated text, all as Columns."""

from pyspark.sql import Column, functions as F

from ..functions.blanks import as_column
from ..functions.text import strip

# A command list argument with its value in quotes, in the two spellings repaired.
QUOTED_ARGUMENT = r"((?:o|i|u)?cmd\d*)='([^']*)'"
SPACED_ARGUMENT = r"((?:o|i|u)?cmd\d*)= '([^\"]*)'"
SPACED_EXCEPTION = "cmd='select"


def quote_step(step) -> Column:
    """One step with its argument in double quotes.

    ``addcol`` and ``replacecol`` keep the column name outside the quotes. A step stays as it
    is when it has no argument or already contains a double quote.
    """
    step = strip(step)
    with_column = r"(?s)^(addcol|replacecol) ([^ ]*) (.*)$"
    return (
        F.when((F.instr(step, " ") == 0) | (F.instr(step, '"') > 0), step)
        .when(step.rlike(with_column), F.regexp_replace(step, with_column, '$1 $2 "$3"'))
        .otherwise(F.regexp_replace(step, r"(?s)^([^ ]*) (.*)$", '$1 "$2"'))
    )


def quote_arguments(response, pattern: str = QUOTED_ARGUMENT, unless: str | None = None) -> Column:
    """Quote the step arguments inside every command list that ``pattern`` finds.

    ``pattern`` has two groups, the argument's name and its value. Responses that contain
    ``unless`` are returned as they are.
    """
    response = as_column(response)
    names = F.regexp_extract_all(response, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(response, F.lit(pattern), F.lit(2))
    gaps = F.split(response, pattern)
    fixed = F.zip_with(
        names,
        values,
        lambda name, value: F.concat(
            name, F.lit("='"), F.array_join(F.transform(F.split(value, ";"), quote_step), "; "), F.lit("'")
        ),
    )
    pieces = F.zip_with(gaps, fixed, lambda gap, part: F.concat(gap, F.coalesce(part, F.lit(""))))
    repaired = F.array_join(pieces, "")
    if unless is None:
        return repaired
    return F.when(F.contains(response, F.lit(unless)), response).otherwise(repaired)


def quote_spaced_arguments(response) -> Column:
    """The second spelling: a space after the equals sign, and no selection in the response."""
    return quote_arguments(response, SPACED_ARGUMENT, SPACED_EXCEPTION)


def extract_tool_call(response, tool: str) -> Column:
    """The description passed to ``tool`` in a generated call.

    Three spellings are tried in turn. A missing terminator means "to the end"; NULL when the
    tool is not named or none of the spellings occurs.
    """
    response = as_column(response)

    def after(marker: str, terminator: str) -> Column:
        # Only the text between the first marker and the next one counts.
        rest = F.try_element_at(F.split(response, f"\\Q{marker}\\E"), F.lit(2))
        return F.btrim(F.split(rest, f"\\Q{terminator}\\E")[0], F.lit("'\""))

    found = F.coalesce(
        after("properties='", "')"), after("description=", ")"), after("type='", "')")
    )
    return F.when(F.contains(response, F.lit(tool)), found)


def extract_answer(text, role: str = "model") -> Column:
    """The stripped text between the first two occurrences of ``role``; NULL when it never occurs."""
    return strip(F.try_element_at(F.split(as_column(text), f"\\Q{role}\\E"), F.lit(2)))

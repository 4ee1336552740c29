"""Putting tables together by rows, by position, and by per-row side tables; histograms over columns."""

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blanks import typed_blank_to_null
from .columns import quoted
from .rank import number_rows

Step = Callable[[DataFrame], DataFrame]


def _apply(df: DataFrame, steps) -> DataFrame:
    for step in steps or ():
        df = step(df)
    return df


def unique_parts(locations: list[str]) -> tuple[list[str], str, str]:
    """(unique part of each location, common prefix, common suffix)."""
    prefix = os.path.commonprefix(locations)
    tails = [l[len(prefix) :] for l in locations]
    suffix = os.path.commonprefix([t[::-1] for t in tails])[::-1]
    parts = [t[: len(t) - len(suffix)] if suffix else t for t in tails]
    return parts, prefix, suffix


def label_locations(df: DataFrame, location: str = "location", sequence: str | None = None, unique: str | None = None) -> DataFrame:
    """Rows of many files with the number of their file (from 1, by location) and the part of its location that differs.

    The common ends of any number of locations are those of the first and the last one in their order, and of the
    first and last one read backwards, so one aggregate finds them.
    """
    result = df
    if unique:
        back = F.reverse(location)
        row = df.agg(F.min(location), F.max(location), F.min(back), F.max(back), F.min(F.length(location))).first()
        prefix = len(os.path.commonprefix(row[:2])) if row[0] is not None else 0
        suffix = min(len(os.path.commonprefix(row[2:4])), row[4] - prefix) if row[0] is not None else 0
        result = result.withColumn(unique, F.substring(F.col(location), F.lit(prefix + 1), F.length(location) - F.lit(prefix + suffix)))
    if sequence:
        numbers = number_rows(df.select(F.col(location).alias("_at")).distinct(), "_at", sequence)
        result = result.join(numbers.withColumn(sequence, F.col(sequence).cast("int")), F.col(location) == F.col("_at")).drop("_at")
    return result


def concatenate(
    tables: list[DataFrame],
    each: list[Step] | None = None,
    after: list[Step] | None = None,
    sequence: str | None = None,
    location: str | None = None,
    unique_location: str | None = None,
    locations: list[str] | None = None,
) -> DataFrame:
    """Alike tables one below the other.

    The same steps are applied to each table before, others to the result. The number and types
    of the columns must agree; names are those of the first table. Columns can be added for the
    table's number (from 1), its location, and the part of the location that differs.
    """
    prepared = [_apply(t, each) for t in tables]
    types = [f.dataType for f in prepared[0].schema]
    for i, t in enumerate(prepared[1:], 2):
        if [f.dataType for f in t.schema] != types:
            raise ValueError(f"table {i} does not have the columns of the first one")
    parts = unique_parts(locations)[0] if unique_location else None
    result = None
    for i, t in enumerate(prepared):
        extra = []
        if sequence:
            extra.append(F.lit(i + 1).alias(sequence))
        if location:
            extra.append(F.lit(locations[i]).alias(location))
        if unique_location:
            extra.append(F.lit(parts[i]).alias(unique_location))
        # Renaming an already equal schema costs nothing, and keeps the union positional.
        t = t.toDF(*prepared[0].columns).select("*", *extra)
        result = t if result is None else result.union(t)
    return _apply(result, after)


def concatenate_unlike(tables: list[DataFrame], each: list[list[Step]] | None = None, after: list[Step] | None = None) -> DataFrame:
    """Unlike tables one below the other, after steps of their own that make them alike."""
    prepared = [_apply(t, s) for t, s in zip(tables, each or [[]] * len(tables))]
    result = prepared[0]
    for t in prepared[1:]:
        if len(t.columns) != len(result.columns):
            raise ValueError("tables have different numbers of columns")
        result = result.union(t)
    return _apply(result, after)


def renamed(df: DataFrame, suffix: str, names: set[str]) -> DataFrame:
    return df.select(*[quoted(c).alias(c + suffix if c in names else c) for c in df.columns])


def fix_columns(tables: list[DataFrame], fixcols: str = "dups", suffixes: list[str] | None = None) -> list[DataFrame]:
    """Tables with their columns renamed for side-by-side use: no, only equal, or all names."""
    suffixes = suffixes or [f"_{i}" for i in range(1, len(tables) + 1)]
    seen: dict[str, int] = {}
    for t in tables:
        for c in t.columns:
            seen[c.lower()] = seen.get(c.lower(), 0) + 1

    def chosen(t: DataFrame) -> set[str]:
        if fixcols == "none":
            return set()
        if fixcols == "all":
            return set(t.columns)
        return {c for c in t.columns if seen[c.lower()] > 1}

    return [renamed(t, s, chosen(t)) for t, s in zip(tables, suffixes)]


def join_rows(tables: list[DataFrame], order_by: list, fixcols: str = "dups", suffixes: list[str] | None = None) -> DataFrame:
    """Tables side by side, row by row in the order given for each; the shortest one sets the length."""
    numbered = [number_rows(t, o) for t, o in zip(tables, order_by)]
    fixed = fix_columns([n.drop("_rn") for n in numbered], fixcols, suffixes)
    result = None
    for n, f in zip(numbered, fixed):
        t = n.select(F.col("_rn"), *[quoted(old).alias(new) for old, new in zip(n.drop("_rn").columns, f.columns)])
        result = t if result is None else result.join(t, "_rn")
    return result.drop("_rn")


def array_join(
    df: DataFrame, location, side: DataFrame, side_location: str, position: str, rows_per_part: int | None = None
) -> DataFrame:
    """Each row with the columns of its own side table attached as arrays.

    All side tables are rows of ``side``, told apart by ``side_location`` and ordered by
    ``position`` (numbered from 0). Rows whose location has no table get NULL. There is one row
    per input row, part 0; with ``rows_per_part``, a longer side table continues in further rows with a higher
    ``part``, for tables that no cell can hold.
    """
    values = [c for c in side.columns if c not in (side_location, position)]
    part = (F.floor(F.col(position) / rows_per_part) if rows_per_part else F.lit(0)).cast("long").alias("part")
    gathered = side.groupBy(quoted(side_location).alias("_location"), part).agg(
        F.array_sort(F.collect_list(F.struct(quoted(position), *[quoted(v) for v in values]))).alias("_rows")
    )
    arrays = gathered.select("_location", "part", *[F.col(f"_rows.{v}").alias(v) for v in values])
    key = quoted(location) if isinstance(location, str) else location
    return (
        df.withColumn("_key", key)
        .join(arrays, F.col("_key") == F.col("_location"), "left")
        .drop("_key", "_location")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    )


def cube(
    df: DataFrame, axes: list[tuple[str, float, float]], weight: str | None = None, combine: str = "sum"
) -> DataFrame:
    """N-dimensional histogram: a row per bin that is not empty.

    Each axis is (column, lower limit, bin width); bins are numbered from 0 at the limit in columns
    ``bin_COLUMN``. Blank coordinates fall in no bin. Counts rows, or combines ``weight`` (blanks left
    out) by sum, mean, min or max.
    """
    def place(column: str, low: float, width: float) -> Column:
        x = quoted(column).cast("double")
        return F.floor((F.when(~F.isnan(x), x) - low) / width).cast("long").alias(f"bin_{column}")

    weights = [typed_blank_to_null(df, weight).alias("_w")] if weight else []
    bins = df.select(*[place(*a) for a in axes], *weights)
    keys = [f"bin_{a[0]}" for a in axes]
    value = F.count("*").alias("n")
    if weight:
        value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[combine]("_w").alias(combine)
    return bins.dropna(subset=keys).groupBy(*keys).agg(value)

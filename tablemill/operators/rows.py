"""Row filters. Each sees the rows its predecessor put out.

A DataFrame has no order of its own, so every filter that depends on positions takes ``order_by``, the
columns of a total order. Heads, tails and ranges of any size go one way, which counts on the first key
and sorts only what lies between two of its values, so no result size forces the table through one task. These
counts are jobs that run while the plan is built.
"""

import os
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.blanks import as_column, is_floating, typed_blank_to_null
from ..session import written
from .rank import grouped_quantiles, number_rows, number_sorted

# The quantile sketch that brackets a run of positions is off by at most one row in so many.
ACCURACY = 10_000
_SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def select_rows(df: DataFrame, condition) -> DataFrame:
    """Rows where the condition is true; blank counts as false."""
    return df.where(condition)


def sort_order(df: DataFrame, keys, down: bool = False, nulls_first: bool = False) -> list[Column]:
    """Sort orders over columns; blanks (NaN too) go last, or first on request.

    Keys are column names or expressions. A minus sign before a name turns that key's direction.
    """
    orders = []
    for column, falling in _directed(df, keys, down):
        if falling:
            orders.append(column.desc_nulls_first() if nulls_first else column.desc_nulls_last())
        else:
            orders.append(column.asc_nulls_first() if nulls_first else column.asc_nulls_last())
    return orders


def _directed(df: DataFrame, keys, down: bool) -> list[tuple[Column, bool]]:
    """Each key as a column, and whether it falls."""
    directed = []
    for key in [keys] if isinstance(keys, (str, Column)) else list(keys):
        falling, column = down, key
        if isinstance(key, str):
            turned = key.startswith("-") and key not in df.columns
            falling = down != turned
            column = typed_blank_to_null(df, key[1:] if turned else key)
        directed.append((column, falling))
    return directed


def _positions(df: DataFrame, keys, down: bool, nulls_first: bool, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of the order, both included, in that order.

    A quantile sketch of the first key gives two values around the positions. The rows before the bracket are counted,
    and those inside it sorted and numbered: a few in 10,000 rows more than asked for near the ends of the table, a few
    in 100 in the middle, and the ties of its ends. Texts are bracketed by the bytes that follow what all of them begin with, again
    and again where very many share these. The count also proves the bracket; should it miss, all rows are numbered.
    """
    order = sort_order(df, keys, down, nulls_first)
    if last < first:
        return df.where(F.lit(False))
    key, falling = _directed(df, keys, down)[0]
    kind = df.select(key.alias("k")).schema["k"].dataType
    inside, before = F.lit(True), 0
    if isinstance(kind, (*_SKETCHED, T.StringType, T.BinaryType)):
        inside, before = _bracket(df, key, kind, falling, nulls_first, first, last)
    numbered = number_rows(df.where(inside), order)
    return numbered.where(F.col("_rn").between(first - before, last - before)).orderBy("_rn").drop("_rn")


# Shares of the rows whose key the sketch tells: close to each other near the ends, where heads and tails are.
_NEAR_END = [m / 10.0**e for e in (4, 3, 2) for m in range(1, 10)]
_SHARES = sorted({0.0, 1.0, *_NEAR_END, *[round(1 - s, 4) for s in _NEAR_END], *[k / 100 for k in range(10, 91)]})
#: Bytes of a text that are compared as one number.
_BYTES = 7


def _bracket(df: DataFrame, key: Column, kind, falling: bool, nulls_first: bool, first: int, last: int) -> tuple[Column, int]:
    """A condition that rows ``first`` to ``last`` meet, and the number of rows before all that meet it."""
    text = isinstance(kind, (T.StringType, T.BinaryType))
    inside, before, shared = F.lit(True), 0, -1
    while True:
        rows = df.where(inside)
        value = key
        if text:
            # The bytes of a text are ordered as the text is.
            low, high = rows.agg(F.min(key).cast("binary"), F.max(key).cast("binary")).first()
            if low is None or low == high:
                return inside, before
            known, shared = shared, len(os.path.commonprefix([bytes(low), bytes(high)]))
            if shared == known:
                # They differ by nothing but zero bytes at their ends.
                return inside, before
            part = F.rpad(F.substring(key.cast("binary"), shared + 1, _BYTES), _BYTES, F.lit(b"\0"))
            value = F.when(key.isNotNull(), F.conv(F.hex(part), 16, 10).cast("long"))
        count, filled, grid = rows.agg(F.count("*"), F.count(value), F.percentile_approx(value, _SHARES, ACCURACY)).first()
        if not filled:
            return inside, before
        blanks = count - filled if nulls_first else 0
        ends = sorted((1 - s if falling else s) for s in ((first - before - blanks) / filled, (last - before - blanks) / filled))
        at_low = max((i for i, s in enumerate(_SHARES) if s <= ends[0] - 2 / ACCURACY), default=None)
        at_high = min((i for i, s in enumerate(_SHARES) if s >= ends[1] + 2 / ACCURACY), default=None)
        above = value >= F.lit(grid[at_low]) if at_low is not None else F.lit(True)
        below = value <= F.lit(grid[at_high]) if at_high is not None else F.lit(True)
        with_blanks = first - before <= blanks if nulls_first else last - before > filled
        now = F.when(value.isNull(), F.lit(with_blanks)).otherwise(above & below)
        outside_first = F.when(value.isNull(), F.lit(nulls_first and not with_blanks)).otherwise(~below if falling else ~above)
        skipped, within = rows.agg(F.count(F.when(outside_first, 1)), F.count(F.when(now, 1))).first()
        if not (before + skipped < first and before + skipped + within >= min(last, before + count)):
            return inside, before
        inside, before = inside & now, before + skipped
        # Texts that agree in these bytes too are looked at further on, if they are many more than those wanted.
        if not text or at_low is None or at_high is None or grid[at_low] != grid[at_high] or within <= 2 * (last - first + 1) + count / 100:
            return inside, before


def head(df: DataFrame, rows: int, order_by) -> DataFrame:
    """The first rows of the order."""
    return _positions(df, order_by, False, False, 1, _whole(rows))


def tail(df: DataFrame, rows: int, order_by) -> DataFrame:
    """The last rows of the order, in that order."""
    last = _positions(df, order_by, True, True, 1, _whole(rows))
    return last.orderBy(*sort_order(df, order_by))


def _whole(rows) -> int:
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 0:
        raise ValueError(f"row count must be a number: {rows!r}")
    return rows


def row_range(df: DataFrame, first: int, last: int | str, order_by) -> DataFrame:
    """Rows ``first`` to ``last`` counted from 1, or ``first`` and ``"+n"`` for n rows."""
    if isinstance(last, str) and last.startswith("+"):
        last = first + int(last[1:]) - 1
    if first < 1 or last < 1:
        raise ValueError("row index must be at least 1")
    return _positions(df, order_by, False, False, first, int(last))


def every(df: DataFrame, step: int, order_by, exact: bool = True) -> DataFrame:
    """Each ``step``-th row, beginning with the first.

    Only the order keys are sorted, written and numbered; rows then meet the keys picked, which Spark broadcasts if they are
    small. Of rows with equal keys, whose order is open, as many are taken as there are picks among them; only
    such rows are numbered themselves. Inexact, it takes about as many rows by a hash of the order key, without any shuffle.
    """
    if exact:
        directed = _directed(df, order_by, False)
        names = [f"_key{i}" for i in range(len(directed))]
        orders = [F.col(n).desc_nulls_last() if falling else F.col(n).asc_nulls_last() for n, (_, falling) in zip(names, directed)]
        placed = number_sorted(df.select(*[c.alias(n) for n, (c, _) in zip(names, directed)]).orderBy(*orders))
        picked = placed.where((F.col("_rn") - 1) % step == 0).groupBy(*names).agg(F.count("*").alias("_picks"))
        picked = written(picked.select(F.struct(*names).alias("_picked"), "_picks"), "picked")
        keyed = df.withColumn("_key", F.struct(*[c.alias(n) for n, (c, _) in zip(names, directed)]))
        met = keyed.join(picked, F.col("_key") == F.col("_picked"))
        if met.count() == (picked.agg(F.sum("_picks")).first()[0] or 0):
            return met.select(*[df[c] for c in df.columns])
        numbered = number_rows(met, sort_order(df, order_by))
        first = numbered.groupBy("_picked").agg(F.min("_rn").alias("_first")).withColumnRenamed("_picked", "_run")
        kept = numbered.join(first, F.col("_picked") == F.col("_run")).where("_rn - _first < _picks")
        return kept.drop("_key", "_picked", "_picks", "_rn", "_run", "_first")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    named = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df.where(F.conv(F.substring(named, 1, 15), 16, 10).cast("long") % step == 0)


def sort(df: DataFrame, keys, down: bool = False, nulls_first: bool = False) -> DataFrame:
    """Sorted by the keys, ascending with blanks last unless told otherwise."""
    return df.orderBy(*sort_order(df, keys, down, nulls_first))


def sort_head(
    df: DataFrame, rows: int, keys, down: bool = False, nulls_first: bool = False, from_tail: bool = False
) -> DataFrame:
    """The first (or last) rows of the sorted table, without sorting all of it.

    Ascending unless ``down``: the brightest ten are the ten smallest magnitudes.
    """
    if not from_tail:
        return _positions(df, keys, down, nulls_first, 1, _whole(rows))
    last = _positions(df, keys, not down, not nulls_first, 1, _whole(rows))
    return last.orderBy(*sort_order(df, keys, down, nulls_first))


def repeat(df: DataFrame, count: int, order_by, by_row: bool = False, copy: str = "copy") -> DataFrame:
    """Every row ``count`` times: the whole table again and again, or each row several times in a row.

    ``copy`` numbers the copies from 1.
    """
    copies = df.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(count))))
    order = sort_order(df, order_by)
    return copies.orderBy(*order, copy) if by_row else copies.orderBy(copy, *order)


def unique(df: DataFrame, order_by, keys: list[str] | None = None, count: str | None = None) -> DataFrame:
    """The first row (in the order) for each distinct value of ``keys`` (all columns by default).

    ``count`` names an optional column with the number of rows that had the value. The first row
    is a minimum, so equal keys collapse before the shuffle however many copies there are.
    """
    keys = list(keys or df.columns)
    rest = [c for c in df.columns if c not in keys]
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    # Blanks last, as in every other order here.
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    aggregates = [F.min_by(F.struct(*rest), place).alias("_kept")] if rest else []
    aggregates.append(F.count("*").alias("_copies"))
    kept = df.groupBy(*keys).agg(*aggregates)
    columns = [F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in df.columns]
    if count:
        columns = [F.col("_copies").alias(count)] + columns
    return kept.select(*columns)


def shuffle(df: DataFrame, keys, seed: int = 0) -> DataFrame:
    """Pseudo-random order fixed by the seed; ``keys`` identify a row."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])), *keys)


def assert_all(df: DataFrame, condition, message: str = "assertion failed") -> DataFrame:
    """The same rows; reading them fails when the condition is not true for one of them."""
    holds = F.coalesce(as_column(condition) if isinstance(condition, Column) else F.expr(condition), F.lit(False))
    # The check is a filter that the optimiser cannot drop, as its outcome depends on the rows.
    return df.where(F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row that tells whether the table is well formed.

    Rows, rows with a NULL key, keys that occur more than once, and NaN cells in the floating
    columns.
    """
    floating = [f.name for f in df.schema if is_floating(f.dataType)]
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count(F.when(no_key, 1)).alias("null_keys"),
        *[F.count(F.when(F.isnan(c), 1)).alias(f"_nan_{i}") for i, c in enumerate(floating)],
    )
    nans = sum((F.coalesce(F.sum(f"_nan_{i}"), F.lit(0)) for i in range(len(floating))), F.lit(0).cast("long"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("null_keys"), F.lit(0)).alias("null_keys"),
        F.count(F.when((F.col("rows") > 1) & (F.col("null_keys") == 0), 1)).alias("duplicate_keys"),
        nans.alias("nan_cells"),
    )


AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "stdev": F.stddev_pop,
    "variance": F.var_pop,
    "sampstdev": F.stddev_samp,
    "sampvariance": F.var_samp,
    "distinct": F.count_distinct,
    # Off by at most one value in 10,000, in one pass; "median" and "Q.nn" are exact.
    "approxmedian": lambda c: F.percentile_approx(c, 0.5, 10_000),
}


def group(df: DataFrame, keys: list[str], aggregates: list[tuple[str, str | Column, str]] = ()) -> DataFrame:
    """One row per key with the number of rows and (function, column, name) aggregates.

    Blanks, NaN included, take no part. Functions are those of AGGREGATES, ``median``, and exact quantiles like ``Q.25``,
    which are found by counting, in jobs that run while the plan is built; no task ever holds the values of a key.
    """
    columns, quantiles = [F.count("*").alias("rows")], []
    for function, value, name in aggregates:
        cell = typed_blank_to_null(df, value) if isinstance(value, str) else value
        share = quantile_share(function)
        if share is None:
            columns.append(AGGREGATES[function](cell).alias(name))
        else:
            quantiles.append((cell, share, name))
    grouped = df.groupBy(*keys).agg(*columns)
    if not quantiles:
        return grouped
    found = grouped_quantiles(df, keys, quantiles)
    joined = grouped.withColumn("_key", F.struct(*keys)).join(found, "_key", "left")
    return joined.select(*keys, "rows", *[name for _, _, name in aggregates])


def quantile_share(function: str) -> float | None:
    """The share of values below: 0.5 for ``median``, 0.25 for ``Q.25``."""
    if function == "median":
        return 0.5
    return float("0" + function[1:]) if re.fullmatch(r"Q\.\d+", function) else None


def cone(df: DataFrame, ra0: float, dec0: float, radius: float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows within ``radius`` degrees of a position.

    The declination limits are plain comparisons with the column, so they reach the file reader.
    """
    from ..functions.sky import sky_distance

    return df.where(
        F.col(dec).between(dec0 - radius, dec0 + radius)
        & (sky_distance(ra, dec, F.lit(float(ra0)), F.lit(float(dec0))) <= radius)
    )

"""Column statistics. A blank (NULL or NaN) cell counts only as bad."""

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.blanks import is_floating
from .columns import quoted
from .rank import exact_quantiles

# The statistics and their defaults, the scale of the scaled median absolute deviation, and the
# number of distinct values above which Cardinality is blank.
SCHEMA_ITEMS = ["Index", "Name", "Class", "Shape", "ElSize", "Units", "Description", "UCD", "Utype", "Xtype"]
VALUE_ITEMS = [
    "NGood", "NBad", "Mean", "StDev", "Variance", "SampStDev", "SampVariance", "MedAbsDev", "ScMedAbsDev",
    "Skew", "Kurtosis", "Minimum", "Maximum", "Sum", "MinPos", "MaxPos", "Cardinality", "Median",
    "Quartile1", "Quartile2", "Quartile3",
]
DEFAULT_ITEMS = ["Name", "Mean", "StDev", "Minimum", "Maximum", "NGood"]
MAD_SCALE = 1.4826
MOST_DISTINCT = 100

_METADATA = {
    "Shape": "shape", "ElSize": "elsize", "Units": "units", "Description": "desc", "UCD": "ucd",
    "Utype": "utype", "Xtype": "xtype",
}
_QUANTILES = {"Median": 0.5, "Quartile1": 0.25, "Quartile2": 0.5, "Quartile3": 0.75}


def _share(item: str) -> float | None:
    if item in _QUANTILES:
        return _QUANTILES[item]
    if re.fullmatch(r"Q\.\d+", item):
        return float("0" + item[1:])
    return None


def _number(df: DataFrame, name: str) -> Column:
    """The cells as doubles with NaN as NULL."""
    value = quoted(name).cast("double")
    return F.when(~F.isnan(value), value) if is_floating(df.schema[name].dataType) else value


def _cell(df: DataFrame, name: str) -> Column:
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(quoted(name)), quoted(name))
    return quoted(name)


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def statistics(
    df: DataFrame,
    columns: list[str] | None = None,
    items: list[str] = DEFAULT_ITEMS,
    approximate: bool = False,
    order_by=None,
) -> DataFrame:
    """One row per column with the wanted items; numeric items are blank for other columns.

    Everything but exact quantiles comes from one aggregate over all columns. Quantiles
    interpolate linearly between neighbouring values and are found by counting, in jobs that run while the plan is
    built, unless ``approximate``: those are sketches in the one aggregate. MinPos and MaxPos
    are row positions from 1 in the order of the columns ``order_by``, blanks last: the rows before the first one with the
    extreme value are counted, so nothing is sorted.
    """
    columns = list(columns or df.columns)
    unknown = [i for i in items if i not in SCHEMA_ITEMS + VALUE_ITEMS and _share(i) is None]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}")
    numeric = [c for c in columns if _is_number(df.schema[c].dataType)]
    place = None
    if {"MinPos", "MaxPos"} & set(items):
        if order_by is None:
            raise ValueError("positions need an order")
        keys = [quoted(k) if isinstance(k, str) else k for k in ([order_by] if isinstance(order_by, (str, Column)) else order_by)]
        place = F.struct(*[x for i, k in enumerate(keys) for x in (k.isNull().alias(f"blank{i}"), k.alias(f"key{i}"))])
    first_places, distinct = _looked_up(df, place, [(c, i) for c in numeric for i in items if i in ("MinPos", "MaxPos")], columns if "Cardinality" in items else [])
    # Whole numbers beyond 2**53 are not doubles; their smallest, largest and sum are as exact as they are.
    whole = bool(numeric) and all(isinstance(df.schema[c].dataType, T.IntegralType) for c in numeric)

    found: dict[tuple[str, str], Column] = {}
    shares = {i: _share(i) for i in items if _share(i) is not None}
    deviations = [i for i in items if i in ("MedAbsDev", "ScMedAbsDev")]
    medians = {}
    numbers = {c: _number(df, c) for c in numeric}

    def quantile(x: Column, wanted) -> Column:
        return F.percentile_approx(x, wanted, 10_000)

    if deviations and approximate:
        row = df.agg(*[quantile(_number(df, c), 0.5).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        medians = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
    elif not approximate and (shares or deviations):
        wanted = {(c, i): (numbers[c], s) for c in numeric for i, s in shares.items()}
        if deviations:
            wanted |= {(c, None): (numbers[c], 0.5) for c in numeric}
        for key, value in zip(wanted, exact_quantiles(df, list(wanted.values()))):
            if key[1] is None:
                medians[key[0]] = value
            else:
                found[key] = F.lit(value).cast("double")
    if deviations and not approximate:
        far = [F.abs(numbers[c] - F.lit(medians[c])) for c in numeric]
        for c, value in zip(numeric, exact_quantiles(df, [(x, 0.5) for x in far])):
            found[(c, "MedAbsDev")] = F.lit(value).cast("double")
            found[(c, "ScMedAbsDev")] = F.lit(value).cast("double") * MAD_SCALE

    aggregates: list[Column] = []

    def aggregated(expression: Column) -> Column:
        name = f"_s{len(aggregates)}"
        aggregates.append(expression.alias(name))
        return F.col(name)

    def value_of(column: str, item: str) -> Column:
        cell, is_number = _cell(df, column), column in numeric
        if item == "NGood":
            return aggregated(F.count(cell))
        if item == "NBad":
            return aggregated(F.count("*") - F.count(cell))
        if item == "Cardinality":
            # Distinct values of a column that may have more than the limit are never counted.
            if column not in distinct:
                return F.lit(None).cast("long")
            # A set of few values; a distinct count would group all other aggregates by the values.
            return limited_cardinality(aggregated(F.size(F.collect_set(cell)).cast("long")))
        exact = whole and item in ("Minimum", "Maximum", "Sum")
        kind = "long" if exact or item in ("MinPos", "MaxPos") else "double"
        if not is_number:
            return F.lit(None).cast(kind)
        if (column, item) in found:
            return found[(column, item)]
        x = _number(df, column)
        if exact:
            return aggregated(_MOMENTS[item](cell.cast("decimal(38,0)")).cast("long"))
        if item in _MOMENTS:
            return aggregated(_MOMENTS[item](x))
        if item in ("MinPos", "MaxPos"):
            first = first_places[column, item]
            return F.lit(None).cast("long") if first is None else aggregated(F.count(F.when(place < first, 1)) + 1)
        if item in shares:
            if (column, "quantiles") not in found:
                # All quantiles of a column from one collection of its values.
                found[(column, "quantiles")] = aggregated(quantile(x, list(shares.values())))
            return found[(column, "quantiles")][list(shares).index(item)].cast("double")
        if (column, "deviation") not in found:
            found[(column, "deviation")] = aggregated(quantile(F.abs(x - F.lit(medians[column])), 0.5))
        return found[(column, "deviation")] * (MAD_SCALE if item == "ScMedAbsDev" else 1.0)

    rows = []
    for i, column in enumerate(columns, 1):
        field = df.schema[column]
        fields = [F.lit(column).alias("Name")] if "Name" not in items else []
        for item in items:
            if item == "Index":
                cell = F.lit(i)
            elif item == "Name":
                cell = F.lit(column)
            elif item == "Class":
                cell = F.lit(field.dataType.simpleString())
            elif item in _METADATA:
                cell = F.lit(field.metadata.get(_METADATA[item])).cast("string")
            else:
                cell = value_of(column, item)
            fields.append(cell.alias(item.replace(".", "_")))
        rows.append(F.struct(*fields))
    if not aggregates:
        aggregates.append(F.count("*").alias("_rows"))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


_MOMENTS = {
    "Mean": F.avg,
    "StDev": F.stddev_pop,
    "Variance": F.var_pop,
    "SampStDev": F.stddev_samp,
    "SampVariance": F.var_samp,
    "Skew": F.skewness,
    "Kurtosis": F.kurtosis,
    "Minimum": F.min,
    "Maximum": F.max,
    "Sum": F.sum,
}


def _looked_up(df: DataFrame, place: Column | None, wanted: list[tuple[str, str]], counted: list[str]) -> tuple[dict, set[str]]:
    """What the statistics need first, in one scan: the place of the first row with a column's smallest or largest
    value, as a literal, and the columns with few enough distinct values to count them exactly.

    The estimate (2 % standard error) only excludes columns that are far above the limit.
    """
    if not wanted and not counted:
        return {}, set()
    columns = [F.approx_count_distinct(_cell(df, c), 0.02).alias(f"_d{i}") for i, c in enumerate(counted)]
    for n, (c, item) in enumerate(wanted):
        x = _number(df, c) * (1 if item == "MinPos" else -1)
        # A minimum, so that tasks can combine their parts.
        columns.append(F.min_by(place, F.when(x.isNotNull(), F.struct(x, place))).alias(f"_p{n}"))
    found = df.agg(*columns).first()
    distinct = {c for c, n in zip(counted, found) if n <= 2 * MOST_DISTINCT}
    if not wanted:
        return {}, distinct
    kinds = df.select(place.alias("place")).schema["place"].dataType
    return {
        key: None if row is None else F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kinds)])
        for key, row in zip(wanted, found[len(counted) :])
    }, distinct


def limited_cardinality(value: Column) -> Column:
    """Blank above the limit."""
    return F.when(value <= MOST_DISTINCT, value)


def array_statistics(df: DataFrame, column: str) -> DataFrame:
    """Per-element count, sum, mean and population standard deviation of an array column, as arrays."""
    elements = df.select(F.posexplode(quoted(column)).alias("pos", "x")).select(
        "pos", F.col("x").cast("double").alias("x")
    )
    x = F.when(~F.isnan("x"), F.col("x"))
    per_element = elements.groupBy("pos").agg(
        F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stdev")
    )
    # One row per array position, and an array has a bounded length: this gathers a single small row.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "n", "sum", "mean", "stdev")))
    gathered = per_element.agg(ordered.alias("e"))
    return gathered.select(
        F.lit(column).alias("Name"),
        F.col("e.n").alias("ArrayNGood"),
        F.col("e.sum").alias("ArraySum"),
        F.col("e.mean").alias("ArrayMean"),
        F.col("e.stdev").alias("ArrayStDev"),
    )


def with_column_statistics(df: DataFrame, column: str, **names: str) -> DataFrame:
    """Whole-column statistics next to each row (``mean="m"``, ``stdev="s"``), as in a sigma clip.

    They are scalar subqueries: one aggregate each, and nothing but a number is sent to the tasks.
    """
    functions = {"mean": F.avg, "stdev": F.stddev_pop, "minimum": F.min, "maximum": F.max, "sum": F.sum}
    x = _number(df, column)
    return df.withColumns({new: df.select(functions[f](x)).scalar() for f, new in names.items()})

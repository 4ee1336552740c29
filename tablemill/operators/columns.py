"""Column filters: naming, adding, replacing, arrays, metadata."""

import fnmatch
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.blanks import as_column, is_blank, is_floating


def resolve(df: DataFrame, *specs) -> list[str]:
    """Column names from names, positions (from 1), ``*`` globs, ``first..last`` ranges and ``ucd$word``."""
    names = df.columns

    def one(spec) -> int:
        if isinstance(spec, int) or (spec not in names and str(spec).isdigit()):
            if not 1 <= int(spec) <= len(names):
                raise ValueError(f"no column number {spec}")
            return int(spec) - 1
        if spec.startswith("ucd$"):
            wanted = spec[4:].replace("_", ".").lower()
            for i, field in enumerate(df.schema):
                if str(field.metadata.get("ucd", "")).lower().startswith(wanted):
                    return i
        elif spec in names:
            return names.index(spec)
        raise ValueError(f"no column {spec}")

    found: list[str] = []
    for spec in specs:
        if isinstance(spec, str) and spec not in names and "*" in spec:
            found += [n for n in names if fnmatch.fnmatchcase(n, spec)]
        elif isinstance(spec, str) and spec not in names and ".." in spec:
            first, last = spec.split("..", 1)
            start = one(first) if first else 0
            end = one(last) if last else len(names) - 1
            found += names[start : end + 1]
        else:
            found.append(names[one(spec)])
    return list(dict.fromkeys(found))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_metadata(column: Column, name: str, metadata: dict) -> Column:
    return column.alias(name, metadata={k: v for k, v in metadata.items() if v is not None})


def add_column(
    df: DataFrame, name: str, value, after=None, before=None, units=None, ucd=None, desc=None, shape=None, **more
) -> DataFrame:
    """A new column at the end, or after or before another one, with metadata."""
    expression = F.expr(value) if isinstance(value, str) else as_column(value)
    new = _with_metadata(expression, name, {"units": units, "ucd": ucd, "desc": desc, "shape": shape, **more})
    columns = [quoted(c) for c in df.columns]
    place = len(columns)
    if after is not None:
        place = df.columns.index(resolve(df, after)[0]) + 1
    elif before is not None:
        place = df.columns.index(resolve(df, before)[0])
    return df.select(*columns[:place], new, *columns[place:])


def replace_column(df: DataFrame, spec, value, name: str | None = None, **metadata) -> DataFrame:
    """A column's values replaced in place by an expression, which may use the old ones."""
    [old] = resolve(df, spec)
    expression = F.expr(value) if isinstance(value, str) else as_column(value)
    new = _with_metadata(expression, name or old, {**df.schema[old].metadata, **metadata})
    return df.select(*[new if c == old else quoted(c) for c in df.columns])


def delete_columns(df: DataFrame, *specs) -> DataFrame:
    dropped = resolve(df, *specs)
    return df.select(*[quoted(c) for c in df.columns if c not in dropped])


def keep_columns(df: DataFrame, *specs) -> DataFrame:
    """Only the listed columns, in the listed order."""
    return df.select(*[quoted(c) for c in resolve(df, *specs)])


def column_metadata(df: DataFrame, *specs, name: str | None = None, **metadata) -> DataFrame:
    """Columns renamed or described (units, ucd, utype, xtype, desc, shape)."""
    chosen = resolve(df, *specs)
    if name is not None and len(chosen) != 1:
        raise ValueError("only one column can get a name")
    columns = []
    for field in df.schema:
        if field.name in chosen:
            described = {**field.metadata, **metadata}
            columns.append(_with_metadata(quoted(field.name), name or field.name, described))
        else:
            columns.append(quoted(field.name))
    return df.select(*columns)


def describe_columns(df: DataFrame) -> list[dict]:
    """Index, name, class and metadata of each column, from the schema alone."""
    return [
        {"index": i, "name": f.name, "class": f.dataType.simpleString(), **f.metadata}
        for i, f in enumerate(df.schema, 1)
    ]


def fix_names(df: DataFrame) -> DataFrame:
    """Names made of letters, digits and underscores, not starting with a digit, unique whatever the case."""
    taken: set[str] = set()
    names = []
    for name in df.columns:
        safe = re.sub(r"\W", "_", name, flags=re.ASCII) or "_"
        if safe[0].isdigit():
            safe = "_" + safe
        base, n = safe, 1
        while safe.lower() in taken:
            n += 1
            safe = f"{base}_{n}"
        taken.add(safe.lower())
        names.append(safe)
    return df.toDF(*names)


def _is_value(df: DataFrame, name: str, value) -> Column:
    column = quoted(name)
    if value is None:
        return is_blank(column) if is_floating(df.schema[name].dataType) else column.isNull()
    return column.eqNullSafe(F.lit(value).cast(df.schema[name].dataType))


def replace_value(df: DataFrame, old, new, *specs) -> DataFrame:
    """One value replaced by another; None on either side stands for blank."""
    chosen = resolve(df, *specs)
    return df.select(
        *[
            F.when(_is_value(df, c, old), F.lit(new).cast(df.schema[c].dataType)).otherwise(quoted(c)).alias(c)
            if c in chosen
            else quoted(c)
            for c in df.columns
        ]
    )


def bad_value(df: DataFrame, bad, *specs) -> DataFrame:
    """A value that stands for "no value" becomes blank."""
    return replace_value(df, bad, None, *specs)


# --- constant columns ------------------------------------------------------------------------------


def _without_nan(df: DataFrame, name: str) -> Column:
    cell = quoted(name)
    return F.when(~F.isnan(cell), cell) if is_floating(df.schema[name].dataType) else cell


def constant_columns(df: DataFrame, *specs, accept_null: bool = False, keep_columns: bool = False) -> tuple[DataFrame, dict]:
    """(table without its constant columns, their values as table parameters).

    A column is constant when all its cells hold the same value; with ``accept_null`` blank cells do
    not count. One pass finds them all.
    """
    chosen = resolve(df, *(specs or ("*",)))
    ends = df.agg(
        F.count("*").alias("_rows"),
        *[f(_without_nan(df, c)).alias(f"_{k}{i}") for i, c in enumerate(chosen) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
    ).first()
    values = {}
    for i, c in enumerate(chosen):
        complete = ends[f"_n{i}"] == ends["_rows"] or (accept_null and ends[f"_n{i}"] > 0)
        if complete and ends["_rows"] > 0 and ends[f"_lo{i}"] == ends[f"_hi{i}"]:
            values[c] = ends[f"_lo{i}"]
    if keep_columns or not values:
        return df, values
    return delete_columns(df, *values), values


def constant_report(df: DataFrame, *specs) -> DataFrame:
    """One row per column: whether it is constant, and its value as text."""
    chosen = resolve(df, *(specs or ("*",)))
    sums = [F.count("*").alias("_rows")]
    for i, c in enumerate(chosen):
        cell = _without_nan(df, c)
        sums += [F.min(cell).alias(f"_lo{i}"), F.max(cell).alias(f"_hi{i}"), F.count(cell).alias(f"_n{i}")]
    rows = []
    for i, c in enumerate(chosen):
        same = (F.col(f"_lo{i}") == F.col(f"_hi{i}")) & (F.col(f"_n{i}") == F.col("_rows"))
        same = F.coalesce(same, F.lit(False))
        rows.append(
            F.struct(F.lit(c).alias("column"), same.alias("constant"), F.when(same, F.col(f"_lo{i}").cast("string")).alias("value"))
        )
    return df.agg(*sums).select(F.inline(F.array(*rows)))


# --- arrays ----------------------------------------------------------------------------------------


def collapse_columns(df: DataFrame, array: str, first, count: int, keep_scalars: bool = False) -> DataFrame:
    """``count`` neighbouring columns from ``first`` on as one array column at their place."""
    start = df.columns.index(resolve(df, first)[0])
    members = df.columns[start : start + count]
    if len(members) < count:
        raise ValueError(f"fewer than {count} columns from {first}")
    new = F.array(*[quoted(c) for c in members]).alias(array, metadata={"shape": str(count)})
    scalars = [quoted(c) for c in members] if keep_scalars else []
    return df.select(
        *[quoted(c) for c in df.columns[:start]], *scalars, new, *[quoted(c) for c in df.columns[start + count :]]
    )


def explode_columns(df: DataFrame, *specs, sizes: dict[str, int] | None = None) -> DataFrame:
    """Array columns as scalar columns NAME_1 … NAME_k.

    k comes from ``sizes``, from the column's shape metadata, or from one pass over the table.
    """
    chosen = resolve(df, *specs)
    size = {c: int(s) for c, s in (sizes or {}).items()}
    for c in chosen:
        shape = str(df.schema[c].metadata.get("shape", ""))
        if c not in size and shape.isdigit():
            size[c] = int(shape)
    unknown = [c for c in chosen if c not in size]
    if unknown:
        widest = df.agg(*[F.max(F.size(quoted(c))).alias(str(i)) for i, c in enumerate(unknown)]).first()
        size.update({c: max(widest[i] or 0, 0) for i, c in enumerate(unknown)})
    columns = []
    for c in df.columns:
        if c in chosen:
            columns += [F.get(quoted(c), F.lit(i)).alias(f"{c}_{i + 1}") for i in range(size[c])]
        else:
            columns.append(quoted(c))
    return df.select(*columns)


def explode_all(df: DataFrame, sizes: dict[str, int] | None = None, dimensions: int | None = None, shape: str | None = None) -> DataFrame:
    """Every array column exploded; with ``dimensions`` or ``shape`` only those of that form."""
    def depth(t: T.DataType) -> int:
        return 1 + depth(t.elementType) if isinstance(t, T.ArrayType) else 0

    chosen = [
        f.name
        for f in df.schema
        if depth(f.dataType) > 0
        and (dimensions is None or depth(f.dataType) == dimensions)
        and (shape is None or str(f.metadata.get("shape", "")) == shape)
    ]
    return explode_columns(df, *chosen, sizes=sizes) if chosen else df


# --- shape -----------------------------------------------------------------------------------------


def transpose(df: DataFrame, name_column: str | None = None, heading: str = "heading") -> DataFrame:
    """Rows and columns swapped; the values of the first (or named) column become the column names.

    The result has a column per row, so the names of all rows make up its schema and are read for it. Values become
    text, as one new column holds what were cells of different types.
    """
    name_column = name_column or df.columns[0]
    names = [r[0] for r in df.select(quoted(name_column).cast("string")).collect()]
    if len(set(names)) < len(names) or None in names:
        raise ValueError(f"{name_column} does not name the rows uniquely")
    values = [c for c in df.columns if c != name_column]
    cells = F.inline(
        F.array(*[F.struct(F.lit(c).alias(heading), quoted(c).cast("string").alias("_cell")) for c in values])
    )
    long = df.select(quoted(name_column).cast("string").alias("_name"), cells)
    return long.groupBy(heading).pivot("_name", sorted(names)).agg(F.first("_cell"))

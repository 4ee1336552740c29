"""What to do with a finished table, other than writing it."""

from pyspark.sql import DataFrame, functions as F, types as T

from .stats import DEFAULT_ITEMS, statistics


def count(df: DataFrame) -> DataFrame:
    """One row: number of columns and rows."""
    return df.agg(F.lit(len(df.columns)).cast("long").alias("columns"), F.count("*").alias("rows"))


def stats(df: DataFrame, items: list[str] = DEFAULT_ITEMS) -> DataFrame:
    """Statistics of all columns."""
    return statistics(df, items=items)


def checksum(df: DataFrame) -> DataFrame:
    """One row: a checksum of the content that does not depend on row order, and the row count.

    A row's number is the first 60 bits of the MD5 of its cells as text, each behind a bar, NULL as a zero character. Equal
    rows would cancel out under exclusive or, so the sum of the numbers goes in as well.
    """
    cells = []
    for field in df.schema:
        cell = F.col("`" + field.name.replace("`", "``") + "`")
        text = F.hex(cell) if isinstance(field.dataType, T.BinaryType) else cell.cast("string")
        cells += [F.lit("|"), F.coalesce(text, F.lit("\0"))]
    row = F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("long") if cells else F.lit(0).cast("long")
    return df.agg(
        F.bit_xor(row).alias("xor"),
        F.sum(row.cast("decimal(38,0)")).alias("total"),
        F.count("*").alias("rows"),
    )


def discard(df: DataFrame) -> None:
    """Compute every row and keep none; an assertion in the table then still fails."""
    df.write.format("noop").mode("overwrite").save()


def out(df: DataFrame, path: str, ofmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the table."""
    from ..sources.tables import write_table

    write_table(df, path, ofmt, mode)

"""Table files: reading, writing and converting between the formats Spark has codecs for."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Format name -> (Spark format, options). Only the first two differ from Spark's own names.
FORMATS = {
    "csv": ("csv", {"header": True}),
    "tsv": ("csv", {"header": True, "sep": "\t"}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "json": ("json", {}),
    "text": ("text", {}),
}


def _codec(name: str) -> tuple[str, dict]:
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown format {name!r}, known formats: {', '.join(FORMATS)}") from None


def read_table(spark: SparkSession, path: str | list[str], ifmt: str, schema=None) -> DataFrame:
    """A table file or folder, or several that are read as one table; text formats need a schema, as nothing is inferred."""
    name, options = _codec(ifmt)
    reader = spark.read.format(name).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_table(df: DataFrame, path: str, ofmt: str, mode: str = "errorifexists") -> None:
    name, options = _codec(ofmt)
    df.write.format(name).options(**options).mode(mode).save(path)


def convert(spark: SparkSession, source: str, ifmt: str, target: str, ofmt: str, schema=None, mode: str = "errorifexists") -> None:
    """Copy a table from one format to another."""
    write_table(read_table(spark, source, ifmt, schema), target, ofmt, mode)


def with_location(df: DataFrame, name: str = "location", whole_table: bool = False) -> DataFrame:
    """Add the path of the file that each row was read from, or of the folder that holds a table's files."""
    path = F.col("_metadata.file_path")
    return df.select("*", (F.regexp_replace(path, "/[^/]*$", "") if whole_table else path).alias(name))


def spread(scan: DataFrame) -> DataFrame:
    """A table just read, dealt out to all cores if it came in fewer parts than there are cores.

    For costly work per row on small inputs; a large table has many parts and stays where it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

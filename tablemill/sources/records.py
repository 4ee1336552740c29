"""Corpus files: JSON arrays of records, XML examples, HTML pages, text lines, CSV metrics."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import LINE_END, clean_lines, strip

# The fields of a record as they are spelled in the files. The schema is declared, never
# inferred: a corpus without failures would otherwise lose its error column.
RECORD_FIELDS = ["prompt", "response", "chat.jar", "error", "cmd", "source_cmd_file"]
RECORD_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])
STATUS_FIELD = "chat.jar"


def _existing(spark: SparkSession, folders: list[str], read) -> list[DataFrame]:
    """One frame per folder; a folder that does not exist is left out."""
    frames = []
    for folder in folders:
        try:
            frames.append(read(folder))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return frames


def _union(spark: SparkSession, frames: list[DataFrame], schema: T.StructType) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _record_columns() -> list[Column]:
    return [F.col(f"`{f}`").alias("status" if f == STATUS_FIELD else f) for f in RECORD_FIELDS] + [
        F.col("file"),
        F.col("path"),
    ]


def is_whole_array(value: Column | str) -> Column:
    """Whether a text is one JSON array and nothing else.

    The parsers stop after the first value, so what follows it goes unseen. Here the text is put once into an array and once
    into an object, where anything after it breaks one of the two.
    """
    value = F.col(value) if isinstance(value, str) else value
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    # A bracket that closes the array too early breaks the object, a brace that closes the object breaks the array.
    only = F.json_object_keys(F.concat(F.lit('{"x":'), value, F.lit("}"))) == F.array(F.lit("x"))
    return F.coalesce(F.startswith(strip(value), F.lit("[")) & alone & only, F.lit(False))


def parse_arrays(files: DataFrame) -> DataFrame:
    """The records of texts (``value``, ``file``, ``path``) that are JSON arrays; other texts, also those with anything
    behind the array, give none.

    Elements that are no objects are skipped, texts that look like one among them; the other elements of their file stay.
    """
    texts = F.from_json("value", T.ArrayType(T.StringType()))
    # The kind of an element is lost in its text. It is unknown (NULL) where some object repeats a key; there, the last one counts.
    kinds = F.transform(F.from_json("value", T.ArrayType(T.VariantType())), lambda v: F.schema_of_variant(v))
    elements = files.where(is_whole_array("value")).select("file", "path", texts.alias("element"), kinds.alias("kind"))
    kinds = F.coalesce("kind", F.transform("element", lambda _: F.lit(None).cast("string")))
    each = elements.withColumn("kind", kinds).select("file", "path", F.inline(F.arrays_zip("element", "kind")))
    unknown = F.col("kind").isNull() & F.startswith(strip("element"), F.lit("{"))
    objects = each.where(unknown | F.startswith("kind", F.lit("OBJECT")))
    return objects.select("file", "path", F.from_json("element", RECORD_SCHEMA).alias("record")).select("file", "path", "record.*").select(*_record_columns())


def read_corpus(spark: SparkSession, *folders: str, pattern: str = "*.json") -> DataFrame:
    """All records of all files named like ``pattern`` directly in the folders.

    Folders that do not exist are skipped, and so are files that are not a JSON array as a whole or cannot be
    parsed. Files are the unit of parallelism, as a JSON array cannot be split. Columns: the record
    fields (with the status field named ``status``), ``file`` and ``path``.
    """
    def whole_files(folder: str) -> DataFrame:
        return (
            spark.read.option("pathGlobFilter", pattern)
            .text(folder, wholetext=True)
            .select(
                "value",
                F.col("_metadata.file_name").alias("file"),
                F.col("_metadata.file_path").alias("path"),
            )
        )

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("value", "file", "path")])
    files = _union(spark, _existing(spark, list(folders), whole_files), schema)
    return parse_arrays(files)


def read_corpus_trusted(spark: SparkSession, *folders: str, pattern: str = "*.json") -> DataFrame:
    """Like :func:`read_corpus` for folders known to hold only good arrays.

    Files are parsed as a stream, so a single file may be larger than one cell can be.
    """
    def records(folder: str) -> DataFrame:
        return (
            spark.read.schema(RECORD_SCHEMA)
            .option("multiLine", True)
            .option("pathGlobFilter", pattern)
            .json(folder)
            .select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
        )

    schema = T.StructType(RECORD_SCHEMA.fields + [T.StructField(n, T.StringType()) for n in ("file", "path")])
    return _union(spark, _existing(spark, list(folders), records), schema).select(*_record_columns())


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, the form to use at scale."""
    df.write.mode(mode).json(path)


def write_record_arrays(
    df: DataFrame, path: str, per_file: int = 10_000, mode: str = "errorifexists", compression: str = "none"
) -> None:
    """Records as files that each hold one JSON array of at most ``per_file`` records.

    ``status`` is written under its name in the files. Chunks are cut within the tasks that produce
    the rows, so no group is larger than ``per_file``. ``compression`` is one of Spark's for text, such as ``gzip``; the readers
    know it by the files' ending.
    """
    fields = [F.col(c).alias(STATUS_FIELD if c == "status" else c) for c in df.columns]
    at = F.monotonically_increasing_id()
    # The task number is in the high bits, the place in the task in the low 33.
    task, place = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.floor(place / per_file).cast("long")
    (
        df.select(task.alias("_task"), chunk.alias("_chunk"), F.struct(*fields).alias("_record"))
        .groupBy("_task", "_chunk")
        .agg(F.to_json(F.collect_list("_record")).alias("value"))
        .select("value")
        .write.mode(mode)
        .option("maxRecordsPerFile", 1)
        .option("lineSep", "\n")
        .option("compression", compression)
        .text(path)
    )


def write_failures(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Failed records, one folder per failure mode (``mode_key=...``)."""
    df.write.mode(mode).partitionBy("mode_key").json(path)


def read_lines(spark: SparkSession, *paths: str, separator: str | None = "\n") -> DataFrame:
    """Lines of text files in column ``text``; without ``separator``, any of the three line ends."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(list(paths)).withColumnRenamed("value", "text")


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of a text column: (key, line number from 0, line)."""
    return df.select(key, F.posexplode(F.split(text, LINE_END)).alias("line_no", "line"))


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and no index."""
    df.write.mode(mode).csv(path, header=True)


def read_metrics(spark: SparkSession, path: str, schema: str = "step LONG, loss DOUBLE") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_examples(spark: SparkSession, path: str, row_tag: str = "example") -> DataFrame:
    """XML examples as records.

    A missing element is the empty string and texts are stripped; examples where both are empty
    are left out.
    """
    fields = ("prompt", "response")
    raw = (
        spark.read.format("xml")
        .schema(", ".join(f"{f} STRING" for f in fields))
        .option("rowTag", row_tag)
        .load(path)
    )
    texts = raw.select(*[strip(F.coalesce(f, F.lit(""))).alias(f) for f in fields])
    return texts.where((F.col("prompt") != "") | (F.col("response") != ""))


def write_examples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as XML examples."""
    (
        df.select("prompt", "response")
        .write.mode(mode)
        .format("xml")
        .option("rootTag", "output")
        .option("rowTag", "example")
        .save(path)
    )


class _TextNodes(HTMLParser):
    """Collects the text of a page; scripts, styles, templates, ruby notes and comments are no text."""

    HIDDEN = {"script", "style", "template", "rt", "rp"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def _page_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    return "".join(parser.pieces)


@F.pandas_udf(T.StringType())
def _page_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(_page_text)


def html_text(html) -> Column:
    """The text of HTML pages: every line stripped, blank lines dropped."""
    return clean_lines(_page_texts(html))

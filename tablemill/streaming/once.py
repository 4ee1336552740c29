"""One sequential pass over files, each read exactly once.

Catalogue tools offer to read an input as a stream when it need not be kept. Here that is a streaming
query that takes all files not seen before and then stops. Its progress is kept at
``checkpoint``, so the next call continues with the files that arrived since.
"""

from pyspark.sql import DataFrame, SparkSession

from ..plans.steps import Step
from ..sources.tables import FORMATS


def process_new_files(
    spark: SparkSession,
    source: str,
    ifmt: str,
    schema,
    steps: list[Step],
    target: str,
    checkpoint: str,
    ofmt: str = "parquet",
) -> None:
    """Apply steps that work row by row to all new files of a folder and append the result to ``target``."""
    name, options = FORMATS[ifmt]
    df: DataFrame = spark.readStream.format(name).options(**options).schema(schema).load(source)
    for one in steps:
        df = df.transform(one)
    out, out_options = FORMATS[ofmt]
    query = (
        df.writeStream.format(out)
        .options(**out_options)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

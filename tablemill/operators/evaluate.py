"""Scoring of generated answers, and the reports over scores and losses."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.blanks import as_column

GOOD_SIMILARITY = 0.95


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    score = pd.Series(0.0, index=a.index)
    size_a, size_b = a.str.len().fillna(0), b.str.len().fillna(0)
    for size in size_a[(size_a > 0) & (size_a == size_b)].unique():
        alike = (size_a == size) & (size_b == size)
        x, y = np.vstack(a[alike]).astype("float64"), np.vstack(b[alike]).astype("float64")
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        products = np.einsum("ij,ij->i", x, y)
        score[alike] = np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
    return score


_cosine_udf = F.pandas_udf(_cosines, T.DoubleType())


def cosine_similarity(a, b) -> Column:
    """Cosine of the angle between two vectors; a missing, empty or zero vector scores 0.

    Batches of vectors go to numpy through Arrow, about seven times as fast as array functions,
    which are interpreted, and as sums written out element by element, which outgrow
    generated code.
    """
    return _cosine_udf(as_column(a), as_column(b))


def embed(df: DataFrame, embedder: Callable[[pd.Series], pd.Series], **columns: str) -> DataFrame:
    """Add an embedding column per text column (``new=old``); empty texts get an empty vector."""
    schema = T.StructType(
        list(df.schema) + [T.StructField(n, T.ArrayType(T.FloatType())) for n in columns]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for new, old in columns.items():
                texts = batch[old]
                filled = texts.notna() & (texts != "")
                vectors = pd.Series([[] for _ in range(len(batch))], index=batch.index, dtype=object)
                if filled.any():
                    vectors.loc[filled] = embedder(texts[filled])
                batch[new] = vectors
            yield batch[schema.names]

    return df.mapInPandas(run, schema)


def generate(df: DataFrame, model: Callable[..., pd.Series], prompt: str = "prompt", **settings) -> DataFrame:
    """Add ``generated``: the model's answer to each prompt, batch by batch.

    ``model`` gets a batch of prompts and the decoding settings, which default to 500 new tokens,
    temperature 0.3 and top-p 0.95.
    """
    settings = {"max_new_tokens": 500, "temperature": 0.3, "top_p": 0.95, **settings}
    schema = T.StructType(list(df.schema) + [T.StructField("generated", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(generated=model(batch[prompt], **settings))[schema.names]

    return df.mapInPandas(run, schema)


def score_answers(df: DataFrame, embedder, generated: str = "generated", expected: str = "response") -> DataFrame:
    """Add ``score``: the similarity of the generated and the expected text."""
    vectors = embed(df, embedder, _generated=generated, _expected=expected)
    return vectors.withColumn("score", cosine_similarity("_generated", "_expected")).drop("_generated", "_expected")


def low_scores(df: DataFrame, limit: float = GOOD_SIMILARITY, *tie_break: str) -> DataFrame:
    """Rows that score strictly below the limit, lowest first."""
    return df.where(F.col("score") < limit).orderBy("score", *tie_break)


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Cases, mean score in percent and population standard deviation (*not* in percent)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("cases"),
        (F.avg("score") * 100).alias("mean_percent"),
        F.stddev_pop("score").alias("std"),
    )


def compare_models(df: DataFrame, model: str = "model") -> DataFrame:
    """Mean and population standard deviation of the score of each model."""
    return df.groupBy(model).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def score_bin(score, bins: int) -> Column:
    """The bin of a score in [0, 1], from 0; the last bin is closed. NULL outside."""
    score = as_column(score)
    return F.when(score.between(0, 1), F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, bins: int, by: str | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Counts per bin of [0, 1], empty bins included, for each model side by side.

    ``df`` has ``score`` and ``model``. With ``by``, the categories are those of ``categories`` (the
    first model's table, as a rule); a category that only another model has is left out.
    """
    models = [r["model"] for r in df.select("model").distinct().orderBy("model").collect()]
    keys = ([by] if by else []) + ["bin"]
    counted = (
        df.select(*([by] if by else []), "model", score_bin("score", bins).alias("bin"))
        .where("bin is not null")
        .groupBy(*keys)
        .agg(*[F.count(F.when(F.col("model") == m, 1)).alias(f"n_{m}") for m in models])
    )
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if by:
        frame = (df if categories is None else categories).select(by).distinct().select(by, every_bin)
    else:
        frame = df.sparkSession.range(1).select(every_bin)
    return frame.join(counted, keys, "left").select(
        *keys, *[F.coalesce(f"n_{m}", F.lit(0).cast("long")).alias(f"n_{m}") for m in models]
    )


def loss_curve(log: DataFrame, column: str = "loss") -> DataFrame:
    """(step, loss) of the log rows that have ``column``."""
    return log.where(F.col(column).isNotNull()).select("step", F.col(column).alias("loss"))


def best_step(curve: DataFrame) -> DataFrame:
    """The smallest loss and the first step that reaches it."""
    return curve.agg(F.min("loss").alias("loss"), F.min_by("step", F.struct("loss", "step")).alias("step"))

"""Generated tables: a loop over numbers, and a simulated sky."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def loop_table(spark: SparkSession, start: int, end: int, step: int = 1, name: str = "i") -> DataFrame:
    """One row per number of the loop, made in parallel."""
    return spark.range(start, end, step).withColumnRenamed("id", name)


def uniform(key: Column | str, seed: int) -> Column:
    """A pseudo-random number in [0, 1) fixed by key and seed, the same wherever the row is computed."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def simulated_sky(source: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """A position spread evenly over the sphere for each key: (key, ra, dec) in degrees."""
    return source.select(
        key,
        (uniform(key, seed) * 360.0).alias("ra"),
        F.degrees(F.asin(uniform(key, seed + 1) * 2.0 - 1.0)).alias("dec"),
    )

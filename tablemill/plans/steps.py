"""Ordered processing steps: each sees the table that its predecessor put out."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from ..operators import modes

Step = Callable[[DataFrame], DataFrame]


def step(operator: Callable[..., DataFrame], *args, **kwargs) -> Step:
    """An operator with everything but its table filled in."""
    return lambda df: operator(df, *args, **kwargs)


def process(df: DataFrame, steps: list[Step], mode: str | None = None, **mode_arguments):
    """Apply the steps in order; with an output mode, finish with it.

    Steps only build the query. Nothing runs until the result is used or the mode's action asks for
    it, so Spark plans the whole chain as one.
    """
    for one in steps:
        df = df.transform(one)
    if mode is None:
        return df
    finish = {
        "out": modes.out,
        "count": modes.count,
        "stats": modes.stats,
        "checksum": modes.checksum,
        "discard": modes.discard,
    }[mode]
    return partial(finish, df, **mode_arguments)()

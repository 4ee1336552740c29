"""Array cells, indexed from 0."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .blanks import as_column


def _numbers(a) -> Column:
    """The elements as doubles, blank ones left out."""
    doubles = F.transform(as_column(a), lambda x: x.cast("double"))
    return F.filter(doubles, lambda x: x.isNotNull() & ~F.isnan(x))


def total(a) -> Column:
    return F.aggregate(_numbers(a), F.lit(0.0), lambda s, x: s + x)


def count(a) -> Column:
    return F.size(_numbers(a))


def mean(a) -> Column:
    return F.try_divide(total(a), count(a))


def variance(a) -> Column:
    """Population variance."""
    return F.aggregate(
        _numbers(a),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda s, x: F.struct(
            (s["n"] + 1.0).alias("n"),
            (s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)).alias("mean"),
            (s["m2"] + (x - s["mean"]) * (x - s["mean"]) * s["n"] / (s["n"] + 1.0)).alias("m2"),
        ),
        lambda s: F.when(s["n"] > 0, s["m2"] / s["n"]),
    )


def stdev(a) -> Column:
    return F.sqrt(variance(a))


def maximum(a) -> Column:
    return F.array_max(_numbers(a))


def minimum(a) -> Column:
    return F.array_min(_numbers(a))


def quantile(a, share: float) -> Column:
    """Quantile with linear interpolation between neighbours."""
    ordered = F.array_sort(_numbers(a))
    at = (F.size(ordered) - 1) * F.lit(float(share))
    low = F.floor(at).cast("int")
    lower = F.try_element_at(ordered, low + 1)
    upper = F.coalesce(F.try_element_at(ordered, low + 2), lower)
    return F.when(F.size(ordered) > 0, lower + (upper - lower) * (at - low))


def median(a) -> Column:
    return quantile(a, 0.5)


def _pairwise(a, b, combine: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(as_column(a), as_column(b), lambda x, y: combine(x.cast("double"), y.cast("double")))


def _with_array_or_number(a, b, combine) -> Column:
    if isinstance(b, (int, float)):
        return F.transform(as_column(a), lambda x: combine(x.cast("double"), F.lit(float(b))))
    return _pairwise(a, b, combine)


def add(a, b) -> Column:
    return _with_array_or_number(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _with_array_or_number(a, b, lambda x, y: x - y)


def multiply(a, b) -> Column:
    return _with_array_or_number(a, b, lambda x, y: x * y)


def divide(a, b) -> Column:
    return _with_array_or_number(a, b, lambda x, y: F.try_divide(x, y))


def reciprocal(a) -> Column:
    return F.transform(as_column(a), lambda x: F.try_divide(F.lit(1.0), x.cast("double")))


def dot_product(a, b) -> Column:
    return F.aggregate(multiply(a, b), F.lit(0.0), lambda s, x: s + x)


def size(a) -> Column:
    return F.size(as_column(a))


def join(a, separator: str) -> Column:
    return F.array_join(as_column(a), separator)


def element(a, index: int) -> Column:
    """``a[index]``; blank outside the array."""
    return F.get(as_column(a), F.lit(index))


def slice_array(a, start: int, end: int) -> Column:
    """Elements ``start`` up to but without ``end``."""
    return F.slice(as_column(a), start + 1, max(end - start, 0))


def pick(a, *indices: int) -> Column:
    return F.array(*[element(a, i) for i in indices])


def constant(n: int, value) -> Column:
    return F.array_repeat(F.lit(value), n)


def sequence(n) -> Column:
    """0, 1, … n-1."""
    n = as_column(n)
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def loop(start: int, end: int, step: int = 1) -> Column:
    """``start`` up to but without ``end``."""
    last = end - 1 if step > 0 else end + 1
    if (last - start) * step < 0:
        return F.array().cast("array<int>")
    return F.sequence(F.lit(start), F.lit(last), F.lit(step))


def array(*values) -> Column:
    return F.array(*[as_column(v) for v in values])


def condition(a, yes, no) -> Column:
    """Per element of a logical array one of two values."""
    return F.transform(as_column(a), lambda x: F.when(x.cast("boolean"), F.lit(yes)).otherwise(F.lit(no)))


def index_of(a, value) -> Column:
    """Position from 0, or -1."""
    return F.array_position(as_column(a), value) - 1


def count_true(a) -> Column:
    return F.size(F.filter(as_column(a), lambda x: x))


def array_func(a, function: Callable[[Column, Column], Column]) -> Column:
    """A function of each element and its index."""
    return F.transform(as_column(a), function)

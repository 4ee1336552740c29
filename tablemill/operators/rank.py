"""Row positions and exact order statistics without a single-partition window.

Three things need a position in a *global* order: numbering rows, picking the k-th smallest
value, and splitting off exactly k rows. A window without partition keys would move the whole
table into one task, so none is used on data here.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blanks import is_floating
from ..session import checkpointed, written

# Fixed by Spark: the low 33 bits of monotonically_increasing_id are the place in the partition.
_PLACE_BITS = 33


def sort_keys(order_by) -> list[Column]:
    """Sort keys, blanks last, from names, Columns or sort orders."""
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]


def number_rows(df: DataFrame, order_by, name: str = "_rn") -> DataFrame:
    """Add the 1-based position of each row in the order of ``order_by``.

    The sorted rows are written once with their place in their sort partition (range
    partitioning splits long runs of equal first keys by the later ones). Each row's number is
    that place plus the sizes of the partitions before it. The table of sizes has one row per sort
    partition, so it is safe to broadcast whatever the size of ``df``.
    """
    return number_sorted(df.orderBy(*sort_keys(order_by)), name)


def number_sorted(df: DataFrame, name: str = "_rn") -> DataFrame:
    """Add the 1-based position of each row of a table that has just been sorted."""
    placed = written(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_place", _PLACE_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_place", "_part", "_start")
    )


def number_by_key(df: DataFrame, key, name: str = "_rn") -> DataFrame:
    """Like :func:`number_rows` for an order whose columns identify a row.

    Only the keys are sorted and written, and the numbers joined back, which spares wide rows
    the way through a sort and a file.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(number_rows(df.select(*keys), keys, name), keys)


# --- order statistics by radix --------------------------------------------------------------------

#: Intervals counted in one pass over the data, at most; more open ones take further passes.
INTERVALS = 32
#: Equal bins of an interval, 12 bits of a number.
BINS = 1 << 12
# More than the exponent of any double, so that bins of small numbers do not meet those below 0.
_EXPONENTS = 1100


def leading_bits(value: Column) -> Column:
    """A bin by sign and exponent: it never falls as ``value`` grows, and numbers of one bin are within a factor of about 2."""
    size = F.when(F.abs(value) == float("inf"), 1e4).otherwise(F.floor(F.log2(F.abs(value)))) + _EXPONENTS
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("int")


def further_bits(value: Column, low: Column, high: Column) -> Column:
    """The bin of a number between two of one sign that are within a factor of about 2: differences are exact, and both ends get
    different bins."""
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def order_statistics(df: DataFrame, wanted: list[tuple[Column, Callable[[int], int]]]) -> list:
    """The exact value at one 1-based rank of each numeric expression, blanks left out.

    ``wanted`` lists (expression, function that gives the rank for the number of values). The first pass counts values by
    sign and exponent, with the smallest and largest value met; the bin that holds a rank is cut into BINS further ones
    in the next pass, until it holds a single value. So there are at most six passes for doubles, however
    many orders of magnitude they span (seven for longs, ten for the longest decimals), and a value shared by a third of all rows ends its search at
    once. Ranks looked for in the same interval of the same expression object share its counts. Only bin
    counts reach the driver (BINS rows for each of at most ``INTERVALS`` intervals), each pass shuffles nothing but
    partial counts. A rank outside 1..n gives None.
    """
    expressions = {id(expr): expr for expr, _ in wanted}
    named = {key: f"_v{i}" for i, key in enumerate(expressions)}
    values = df.select(*[expr.alias(named[key]) for key, expr in expressions.items()])
    found: list = [None] * len(wanted)
    open_items = {}
    counted = _counts(values, [(n, None, None) for n in named.values()])
    for i, (expr, rank_of) in enumerate(wanted):
        interval = (named[id(expr)], None, None)
        count = sum(row["n"] for row in counted[interval])
        rank = rank_of(count) if count else 0
        if 1 <= rank <= count:
            open_items[i] = (interval, rank)
    while open_items:
        still_open = {}
        for i, (interval, rank) in open_items.items():
            for row in counted[interval]:
                if rank <= row["n"]:
                    if row["lo"] == row["hi"]:
                        found[i] = row["lo"]
                    else:
                        still_open[i] = ((interval[0], row["lo"], row["hi"]), rank)
                    break
                rank -= row["n"]
        open_items = still_open
        intervals = list(dict.fromkeys(interval for interval, _ in open_items.values()))
        counted = {}
        for start in range(0, len(intervals), INTERVALS):
            counted |= _counts(values, intervals[start : start + INTERVALS])
    return found


def _counts(values: DataFrame, intervals: list[tuple]) -> dict[tuple, list]:
    """The filled bins of each interval (column, smallest, largest value; None for all values) in order."""
    # One array slot per interval; those over columns of different types are counted apart.
    by_type: dict = {}
    for i, (name, lo, hi) in enumerate(intervals):
        value = F.col(name)
        kind = values.schema[name].dataType
        if is_floating(kind):
            value = F.when(~F.isnan(value), value)
        if lo is None:
            cell = F.when(value.isNotNull(), leading_bits(value.cast("double")))
        else:
            cell = F.when(value.between(F.lit(lo), F.lit(hi)), further_bits(value, F.lit(lo), F.lit(hi)))
        by_type.setdefault(kind, []).append(F.struct(F.lit(i).alias("item"), cell.alias("bin"), value.alias("value")))
    counted: dict[tuple, list] = {interval: [] for interval in intervals}
    for group in by_type.values():
        rows = (
            values.select(F.explode(F.array(*group)).alias("c"))
            .select("c.*")
            .where("bin is not null")
            .groupBy("item", "bin")
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        for row in sorted(rows, key=lambda r: (r["item"], r["bin"])):
            counted[intervals[row["item"]]].append(row)
    return counted


def grouped_quantiles(df: DataFrame, keys: list[str], wanted: list[tuple[Column, float, str]]) -> DataFrame:
    """One row per key with exact quantiles (value, share, name), linear between neighbouring values, blanks left out.

    The passes of :func:`order_statistics` for all keys at once: what is shuffled, and what a task holds, are counts per key
    and bin, however many values a key has. A pass joins the rows with the intervals of their key that are still open,
    at most two for each quantile. Each pass writes its intervals as a table, so this runs jobs.
    """
    spread = []
    for i, (value, share, _) in enumerate(wanted):
        spread.append(F.struct(F.lit(i).alias("item"), F.nanvl(value.cast("double"), F.lit(None)).alias("value")))
    key = F.struct(*[F.col(k) for k in keys]).alias("_key")
    values = df.select(key, F.explode(F.array(*spread)).alias("c")).select("_key", "c.*").where("value is not null")
    shares = F.element_at(F.array(*[F.lit(float(s)) for _, s, _ in wanted]), F.col("item") + 1)

    def counted(rows: DataFrame, by: list, cell: Column) -> DataFrame:
        """Filled bins with the number of values up to their end."""
        bins = rows.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        return bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")))

    bins = counted(values, ["_key", "item"], leading_bits(F.col("value")))
    bins = bins.withColumn("count", F.sum("n").over(Window.partitionBy("_key", "item")))
    at = (F.col("count") - 1) * shares
    # The ranks of both neighbours; the upper one of the last value is the value itself.
    ranks = F.array(F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("count")))
    bins = bins.withColumn("weight", at - F.floor(at)).select("*", F.posexplode(ranks).alias("side", "rank"))
    inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
    names = ["_key", "item", "side", "weight", "lo", "hi", "rest"]
    rest = (F.col("rank") - F.col("upto") + F.col("n")).alias("rest")
    found = None
    state = checkpointed(bins.where(inside).select(*names[:-1], rest))
    while True:
        done = state.where("lo = hi")
        found = done if found is None else found.unionByName(done)
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        # Both neighbours mostly lie in one interval, which is counted once.
        intervals = state.select("_key", "item", F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        within = values.join(intervals, ["_key", "item"]).where(F.col("value").between(F.col("from"), F.col("to")))
        cell = further_bits(F.col("value"), F.col("from"), F.col("to"))
        bins = counted(within, ["_key", "item", "from", "to"], cell).select("_key", "item", "from", "to", "n", "lo", "hi", "upto")
        looked = state.select("_key", "item", "side", "weight", F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("rest").alias("rank"))
        state = checkpointed(bins.join(looked, ["_key", "item", "from", "to"]).where(inside).select(*names[:-1], rest))
    low, high = [F.max(F.when(F.col("side") == side, F.col("lo"))) for side in (0, 1)]
    weight = F.max("weight")
    per_item = found.groupBy("_key", "item").agg(F.when(low == high, low).otherwise(low * (1 - weight) + high * weight).alias("value"))
    columns = [F.max(F.when(F.col("item") == i, F.col("value"))).alias(name) for i, (_, _, name) in enumerate(wanted)]
    return per_item.groupBy("_key").agg(*columns)


def exact_quantiles(df: DataFrame, wanted: list[tuple[Column, float]]) -> list:
    """Exact quantiles with linear interpolation between neighbouring values, blanks left out."""
    counts: list[int] = [0] * len(wanted)

    def lower(i: int, share: float) -> Callable[[int], int]:
        def rank(n: int) -> int:
            counts[i] = n
            return int((n - 1) * share) + 1

        return rank

    def upper(share: float) -> Callable[[int], int]:
        return lambda n: min(int((n - 1) * share) + 2, n)

    ranks = []
    for i, (expr, share) in enumerate(wanted):
        ranks += [(expr, lower(i, share)), (expr, upper(share))]
    values = order_statistics(df, ranks)
    result = []
    for i, (_, share) in enumerate(wanted):
        a, b = values[2 * i], values[2 * i + 1]
        if a is None:
            result.append(None)
            continue
        at = (counts[i] - 1) * share
        fraction = at - int(at)
        result.append(float(a) if a == b else float(a) * (1 - fraction) + float(b) * fraction)
    return result


def rank_within(df: DataFrame, keys: list[str], order_by, name: str = "_rank") -> DataFrame:
    """Add the 1-based position of each row among the rows with the same keys.

    A window over the keys would put a key with a third of all rows into one task. Here all rows
    are numbered in the order of keys and ``order_by``, which is spread by ranges, and the number of
    each key's first row is taken off; that part is a join with one row per key, whose hot keys
    adaptive execution can split.
    """
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    numbered = number_rows(df, [*keys, *order], "_rn")
    first = numbered.groupBy(*keys).agg(F.min("_rn").alias("_first"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return (
        numbered.alias("n")
        .join(first.alias("f"), same)
        .select(*[F.col(f"n.{c}") for c in df.columns], (F.col("_rn") - F.col("_first") + 1).alias(name))
    )

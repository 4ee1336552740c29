"""Curation of prompt/response records: statuses, failure classes, admission, reports, splits."""

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.blanks import as_column
from ..functions.text import file_safe, file_stem, strip

# Statuses of a checked record.
SUCCESS = "executed successfully"
FAILED = "failed"
FIXED = "fixed"
SKIPPED = "skipped"
SKIPPED_PLOT = "skipped-plot"
SKIPPED_PARAMETER = "skipped-operaton in param"

# Failure modes in the order in which they are tried.
FAILURE_MODES = [
    "Error: No handler for output format",
    "(Hint: arguments containing spaces must be quoted)",
    "Unused arguments",
    "/bin/sh",
    "Error: No file, URL or command",
    "Error: Unknown processing comm",
    "Error: Row index",
    "Error: Row count",
    "Error: Bad value for parameter",
    "Error: Bad Expression",
    "Error: Can't guess output format",
    "No such file or directory",
    "Premature end of file",
]


def skipped_without_prefix(tool: str) -> str:
    """The status of a response that is not a command of ``tool``."""
    return f"skipped - no '{tool}' prefix"


def repaired_statuses(tool: str) -> list[str]:
    """Statuses under which a record from the repaired corpus is kept."""
    return [
        FIXED,
        SUCCESS,
        SKIPPED,
        skipped_without_prefix(tool),
        SKIPPED_PLOT,
        SKIPPED_PARAMETER,
    ]


# --- rows ---------------------------------------------------------------------------------------


def tag_with_file(df: DataFrame, file: str = "file", name: str = "cmd") -> DataFrame:
    """Set ``name`` to the stem of each row's file name."""
    return df.withColumn(name, file_stem(file))


def normalise_status(status) -> Column:
    """Lower case, stripped; a missing status is the empty string.

    A JSON null cannot be told from a missing key after loading, so both give the empty string.
    """
    return F.lower(strip(F.coalesce(as_column(status), F.lit(""))))


def failed_rows(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows whose status is exactly ``failed``; case and spaces are not forgiven here."""
    return df.where(F.col(status) == FAILED)


def distinct_statuses(df: DataFrame, status: str = "status") -> DataFrame:
    return df.select(normalise_status(status).alias(status)).distinct()


def clean_command(response, tool: str) -> Column:
    """Without every ``java -jar TOOL.jar``, then without every ``TOOL``, stripped.

    File names that contain the tool's name lose it too.
    """
    text = F.replace(as_column(response), F.lit(f"java -jar {tool}.jar"), F.lit(""))
    return strip(F.replace(text, F.lit(tool), F.lit("")))


def gate_commands(df: DataFrame, tool: str, response: str = "response") -> DataFrame:
    """Mark responses that do not start with ``tool`` as skipped, and clean the others.

    Adds ``status`` (only for skipped rows) and ``command`` (only for the others).
    """
    is_command = F.startswith(F.col(response), F.lit(tool))
    return df.withColumns(
        {
            "status": F.when(~is_command, skipped_without_prefix(tool)),
            "command": F.when(is_command, clean_command(response, tool)),
        }
    )


def validate(df: DataFrame, checker: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Check every cleaned command and set ``status`` and ``error``.

    ``checker`` gets a batch of commands and returns one error text per command, None where the
    command is good. Rows without a command keep their status. Batches go through Arrow, so memory
    is bounded by the batch size and the check runs on every executor at once.
    """
    schema = T.StructType(
        [f for f in df.schema if f.name not in ("status", "error")]
        + [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = batch["status"].astype(object) if "status" in batch else pd.Series(None, batch.index, object)
            error = batch["error"].astype(object) if "error" in batch else pd.Series(None, batch.index, object)
            checked = batch["command"].notna()
            found = checker(batch.loc[checked, "command"]).astype(object)
            status.loc[checked] = [SUCCESS if pd.isna(e) else FAILED for e in found]
            error.loc[checked] = [None if pd.isna(e) else e for e in found]
            yield batch.assign(status=status, error=error)[schema.names]

    return df.mapInPandas(check, schema)


def apply_results(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Set ``status`` and ``error`` from a table of check results (``key``, ``error``).

    Rows with a command but without a result stay unchecked; one result per key is expected.
    """
    found = results.select(key, F.col("error").alias("_error"), F.lit(True).alias("_checked"))
    checked = F.col("_checked") & F.col("command").isNotNull()
    return (
        df.join(found, key, "left")
        .withColumn(
            "status",
            F.when(checked & F.col("_error").isNull(), SUCCESS)
            .when(checked, FAILED)
            .otherwise(F.col("status")),
        )
        .withColumn("error", F.when(checked, F.col("_error")))
        .drop("_error", "_checked")
    )


def classify_error(error, modes: list[str] = FAILURE_MODES) -> Column:
    """The first mode whose text occurs in the error; NULL when none does."""
    error = as_column(error)
    return F.coalesce(*[F.when(F.contains(error, F.lit(m)), F.lit(m)) for m in modes])


# --- counts and reports --------------------------------------------------------------------------


def count_each(df: DataFrame, conditions: dict[str, Column], key: str, total: str | None = None) -> DataFrame:
    """One row per named condition with the number of rows that meet it, in the given order.

    All counts come from one global aggregate, so names nobody meets appear with 0, a row can
    count under several names, and a name that a third of all rows meet costs nothing extra: no
    rows are shuffled, only one partial count per task. ``total`` names an optional last row with
    the sum of all counts.
    """
    names = list(conditions)
    sums = [F.count(F.when(conditions[n], 1)).alias(f"c{i}") for i, n in enumerate(names)]
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(n).alias(key), F.col(f"c{i}").alias("n"))
        for i, n in enumerate(names)
    ]
    if total is not None:
        everything = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0).cast("long"))
        rows.append(F.struct(F.lit(len(names)).alias("place"), F.lit(total).alias(key), everything.alias("n")))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def failure_counts(df: DataFrame, modes: list[str] = FAILURE_MODES) -> DataFrame:
    """How often each failure mode is the first match among failed rows, zeros included."""
    mode = failed_rows(df).select(classify_error(F.coalesce("error", F.lit("")), modes).alias("mode"))
    return count_each(mode, {m: F.col("mode") == m for m in modes}, "mode")


def entries_per_key(df: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """Rows per key, where a file belongs to *every* key that its path contains, and the total.

    A file whose path contains two keys counts twice, in the total too.
    """
    return count_each(
        df, {k: F.contains(F.col(file), F.lit(k)) for k in keys}, "key", total="total"
    )


def files_per_key(files: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """One row per (file, key contained in its path): the substring join.

    The keys are a literal list, so this is an expression per row and needs no join.
    """
    found = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.col(file), k))
    return files.select("*", F.explode(found).alias("key"))


def quality_by_file(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows, failed rows and the failure percentage as text, per file."""
    failures = F.count(F.when(F.col("status") == FAILED, 1))
    share = F.when(F.count("*") > 0, failures / F.count("*") * 100).otherwise(F.lit(0.0))
    return df.groupBy(file).agg(
        F.count("*").alias("total"),
        failures.alias("failed"),
        F.format_string("%.2f%%", share).alias("failure_percentage"),
    )


def validity_by_file(df: DataFrame, file: str = "file") -> DataFrame:
    """Failed, successful and other rows (other includes missing) and percent valid, per file."""
    status = F.col("status")
    good = F.count(F.when(status == SUCCESS, 1))
    bad = F.count(F.when(status == FAILED, 1))
    return df.groupBy(file).agg(
        F.count("*").alias("total"),
        bad.alias("failed"),
        good.alias("success"),
        (F.count("*") - good - bad).alias("other"),
        (good / F.count("*") * 100).alias("valid_rate"),
    )


def mean_validity(by_file: DataFrame) -> DataFrame:
    """Unweighted mean over files of the percentage of valid rows."""
    return by_file.agg(F.avg("valid_rate").alias("mean_valid_rate"))


def funnel(main: DataFrame, repaired: DataFrame, tool: str, key: str = "cmd") -> DataFrame:
    """What became of the records of each command.

    ``removed`` is the repaired corpus' own failures plus the failures of the main corpus that no
    repaired record replaces. Rows without a command count nowhere. One tagged union and one
    aggregate stand in for a full outer join of four counts.
    """
    tagged = main.select(key, normalise_status("status").alias("status"), F.lit(True).alias("main")).unionByName(
        repaired.select(key, normalise_status("status").alias("status"), F.lit(False).alias("main"))
    )
    status, is_main = F.col("status"), F.col("main")

    def rows(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = (
        tagged.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(
            rows(is_main & status.isin(SUCCESS, skipped_without_prefix(tool))).alias("success"),
            rows(is_main & (status == FAILED)).alias("failure"),
            rows(~is_main & status.isin(*repaired_statuses(tool))).alias("fixed"),
            rows(~is_main & (status == FAILED)).alias("unrepaired"),
        )
        .where("success + failure + fixed + unrepaired > 0")
    )
    total = F.col("success") + F.col("failure")
    final = F.col("success") + F.col("fixed")
    return counts.select(
        key,
        total.alias("total"),
        "failure",
        "success",
        (F.col("unrepaired") + F.col("failure") - F.col("fixed")).alias("removed"),
        "fixed",
        final.alias("final"),
        F.when(total > 0, final / total * 100).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def funnel_totals(per_command: DataFrame) -> DataFrame:
    """Totals over all commands.

    ``total_removed`` leaves out the repaired corpus' own failures, so it differs from the sum of
    the column ``removed``; that is the documented behaviour.
    """
    sums = per_command.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "final", "failure", "fixed")]
    )
    return sums.select(
        F.col("total").alias("total_generated"),
        F.col("final").alias("total_training"),
        (F.col("failure") - F.col("fixed")).alias("total_removed"),
        F.col("fixed").alias("total_fixed"),
        F.col("failure").alias("total_failed"),
        F.when(F.col("total") > 0, F.col("final") / F.col("total") * 100)
        .otherwise(F.lit(0.0))
        .alias("overall_success_rate"),
    )


# --- admission, order, split ---------------------------------------------------------------------


def concatenate(*frames: DataFrame) -> DataFrame:
    """All records one after the other; keys that a corpus lacks become NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def admit(main: DataFrame, repaired: DataFrame, tool: str) -> DataFrame:
    """The usable records: all of ``main`` that did not fail, and of ``repaired`` only listed statuses."""
    return concatenate(
        main.where(normalise_status("status") != FAILED),
        repaired.where(normalise_status("status").isin(*repaired_statuses(tool))),
    )


def _draw(key, seed: int) -> Column:
    """A 60-bit pseudo-random number that depends only on the key and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), as_column(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def holdout_split(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``floor(n * fraction)`` test rows, drawn at random.

    ``key`` must be unique. A row's draw is a hash of its key, so the split does not depend on
    partitioning and stays the same when tasks are run again. Draws are spread evenly, so the k-th smallest lies near k / n of
    their range: draws there are counted in narrow bins, and the one with the rank is looked at row by row. Both
    parts are then plain filters over the input, with no sort and no shuffle.
    """
    drawn = df.withColumn("_draw", _draw(key, seed))
    count = df.count()
    size = int(count * fraction)
    if size < 1:
        return df, df.limit(0)
    middle, spread = size / count, 8 * math.sqrt(1 / count)
    low, high = max(int((middle - spread) * _DRAWS), 0), min(int((middle + spread) * _DRAWS), _DRAWS - 1)
    while True:
        width = max((high - low) // _BINS, 1)
        place = F.when(F.col("_draw") < low, -1).when(F.col("_draw") > high, _BINS + 2).otherwise(F.floor((F.col("_draw") - low) / width))
        bins = drawn.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("_draw").alias("lo"), F.max("_draw").alias("hi"))
        rank, wanted = size, None
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):
            if rank <= row["n"]:
                wanted = row
                break
            rank -= row["n"]
        # A bin beyond the ends, or one with very many rows (keys that repeat), is cut again.
        low, high = wanted["lo"], wanted["hi"]
        if wanted["n"] <= _ROWS_OF_A_BIN or low == high:
            break
    inside = drawn.where(F.col("_draw").between(low, high)).select("_draw", F.col(key).alias("_last"))
    last = inside.orderBy("_draw", "_last").limit(rank).agg(F.max(F.struct("_draw", "_last")).alias("x")).first()["x"]
    # Rows that share the last draw (a hash collision) are taken in key order.
    draw = F.lit(last["_draw"])
    is_test = (F.col("_draw") < draw) | ((F.col("_draw") == draw) & (F.col(key) <= F.lit(last["_last"])))
    return drawn.where(~is_test).drop("_draw"), drawn.where(is_test).drop("_draw")


# Draws have 60 bits; their bins, and the rows of a bin that are sorted.
_DRAWS, _BINS, _ROWS_OF_A_BIN = 1 << 60, 4096, 10_000


def shuffle_rows(df: DataFrame, key, seed: int = 42) -> DataFrame:
    """Pseudo-random order that the seed repeats; ``key`` (one or more columns) must be unique."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])), *keys)


def ordered_report(df: DataFrame, *order_by) -> DataFrame:
    """A report sorted by score, category or command."""
    return df.orderBy(*order_by)


def sample_texts(df: DataFrame, order_by: str, text: str = "text", rows: int = 2, characters: int = 500) -> DataFrame:
    """The first rows for display, long texts cut and marked with three dots."""
    shown = F.when(
        F.length(text) > characters, F.concat(F.left(text, F.lit(characters)), F.lit("..."))
    ).otherwise(F.col(text))
    return df.orderBy(order_by).limit(rows).withColumn(text, shown)


def failures_by_mode(df: DataFrame, source: str = "file", modes: list[str] = FAILURE_MODES) -> DataFrame:
    """Failed rows with their mode, a file-safe ``mode_key`` and the file they came from.

    Rows that match no mode are left out, as nothing is written for them.
    """
    return (
        failed_rows(df)
        .withColumn("mode", classify_error("error", modes))
        .where("mode is not null")
        .withColumn("mode_key", file_safe("mode"))
        .withColumn("source_cmd_file", F.col(source))
    )

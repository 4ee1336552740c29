"""Training-set preparation: chat templates, tokens, fixed blocks."""

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.blanks import as_column
from ..functions.text import strip
from .rank import number_by_key, number_rows

# The markers of the chat template.
BEGIN = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>"
USER = "user"
ASSISTANT = "assistant"
GENERATION_ROLE = "model"


def render_turn(role, content) -> Column:
    """One turn of the template; the content is stripped."""
    return F.concat(
        F.lit(TURN_START), as_column(role), F.lit("\n"), strip(content), F.lit(TURN_END + "\n")
    )


def render_record(prompt="prompt", response="response", begin: str = BEGIN) -> Column:
    """A prompt/response record as a user turn and an assistant turn."""
    return F.concat(
        F.lit(begin), render_turn(F.lit(USER), prompt), render_turn(F.lit(ASSISTANT), response)
    )


def inference_prompt(prompt="prompt") -> Column:
    """A prompt with an open turn for the answer. The open role is ``assistant`` and the prompt is not
    stripped, unlike in training."""
    return F.concat(
        F.lit(f"{BEGIN}{TURN_START}{USER}\n"),
        as_column(prompt),
        F.lit(f"{TURN_END}\n{TURN_START}{ASSISTANT}\n"),
    )


def render_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", generation: bool = False) -> DataFrame:
    """Each turn's piece of its rendered conversation; joined in turn order the pieces are the text.

    The template refuses conversations that open with a system turn: their pieces are NULL and
    ``rejected`` is true. The first role and the last turn come from an aggregate with partial
    results, so a conversation of any length is spread over many tasks.
    """
    ends = df.groupBy(conversation).agg(
        F.min(F.struct(turn, "role")).alias("_first"), F.max(turn).alias("_last")
    )
    rejected = F.coalesce(F.col("_first.role") == "system", F.lit(False))
    piece = F.concat(
        F.when(F.col(turn) == F.col(f"_first.{turn}"), BEGIN).otherwise(""),
        render_turn("role", "text"),
        F.when(F.lit(generation) & (F.col(turn) == F.col("_last")), f"{TURN_START}{GENERATION_ROLE}\n").otherwise(""),
    )
    return (
        df.join(ends, conversation)
        .withColumns({"rejected": rejected, "piece": F.when(~rejected, piece)})
        .drop("_first", "_last")
    )


def render_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    generation: bool = False,
    turns_per_part: int | None = None,
) -> DataFrame:
    """Whole conversations as template text: (conversation, part, turns, rejected, text).

    A conversation is one row, part 0. With ``turns_per_part``, one with more turn numbers continues
    in further parts, for conversations that no cell can hold; nothing is cut off. ``render_turns`` gives the
    pieces without gathering them.
    """
    pieces = render_turns(df, conversation, turn, generation)
    part = (F.floor(F.col(turn) / turns_per_part) if turns_per_part else F.lit(0)).cast("long").alias("part")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("piece"))))
    text = F.array_join(F.transform(ordered, lambda p: p["piece"]), "")
    return pieces.groupBy(conversation, part).agg(
        F.count("*").alias("turns"),
        F.first("rejected").alias("rejected"),
        F.when(~F.first("rejected"), text).alias("text"),
    )


def word_tokens(text) -> Column:
    """The default tokens: runs of letters, digits or underscores, and single other characters."""
    return F.regexp_extract_all(
        as_column(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)
    )


#: Characters of texts that a tokenizer gets at once, unless a single text is longer.
CHARACTERS = 1 << 20


def tokenise(
    df: DataFrame,
    tokenizer: Callable[[pd.Series], pd.Series],
    text: str = "text",
    token_type: T.DataType = T.IntegerType(),
) -> DataFrame:
    """Replace ``text`` by ``input_ids`` and ``attention_mask``.

    ``tokenizer`` gets a batch of texts and returns one list of token ids per text. Batches end at CHARACTERS, so that the
    lists of a task take a bounded amount of memory, however many rows come at once. Rows without a text get no lists (NULL)
    and stay out of the batches.
    """
    kept = [f for f in df.schema if f.name != text]
    schema = T.StructType(
        kept
        + [
            T.StructField("input_ids", T.ArrayType(token_type)),
            T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
        ]
    )

    most = CHARACTERS

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for batch in _cut_by_length(rows, text, most):
                ids = _of_texts(tokenizer, batch[text])
                mask = ids.map(lambda tokens: [1] * len(tokens), na_action="ignore")
                yield batch.drop(columns=[text]).assign(input_ids=ids, attention_mask=mask)[schema.names]

    return df.mapInPandas(encode, schema)


def _cut_by_length(rows: pd.DataFrame, text: str, most: int) -> Iterator[pd.DataFrame]:
    """Runs of rows whose texts have ``most`` characters together, or of one row."""
    start, size = 0, 0
    for at, length in enumerate(rows[text].str.len().fillna(0).astype("int64")):
        if at > start and size + length > most:
            yield rows.iloc[start:at].reset_index(drop=True)
            start, size = at, 0
        size += length
    yield rows.iloc[start:].reset_index(drop=True)


def _of_texts(tokenizer: Callable[[pd.Series], pd.Series], texts: pd.Series) -> pd.Series:
    """The lists of all texts, and None where there is no text."""
    given = texts.notna()
    if given.all():
        return tokenizer(texts)
    ids = pd.Series([None] * len(texts), dtype=object)
    if given.any():
        ids[given] = tokenizer(texts[given].reset_index(drop=True)).to_numpy()
    return ids


def batch_rows(df: DataFrame, key, batch_size: int = 1000) -> DataFrame:
    """Add the position in its batch (``batch_row``) and the batch number (``batch_id``, from 0).

    Batches are runs of ``batch_size`` rows in the order of the unique ``key``.
    """
    at = F.col("_rn") - 1
    return (
        number_by_key(df, key)
        .withColumns({"batch_id": F.floor(at / batch_size).cast("long"), "batch_row": at % batch_size})
        .drop("_rn")
    )


def pack_blocks(
    batched: DataFrame, block: int = 1024, tokens: str = "input_ids", parallel: tuple[str, ...] = ()
) -> DataFrame:
    """Concatenate the tokens of each batch and cut them in blocks: (batch_id, block_id, input_ids, …, labels).

    What is left of a batch after its last whole block is dropped, but a batch shorter than one
    block gives one short block. ``parallel`` names further lists (an attention mask) that are cut in
    the same places. Rows carry ``batch_id`` and ``batch_row``.

    A batch has a fixed number of rows. They are brought together once, the running sum of the
    list lengths finds the block limits, each list is cut there, and the pieces are gathered per
    block, which needs no further shuffle.
    """
    lists = (tokens, *parallel)
    return _blocks(batched.select("batch_id", "batch_row", *lists), block, lists, ["batch_id"])


#: Runs of batches that are dealt out, at most; the first key of each is known to every task.
MOST_RUNS = 1 << 16


def pack_rows(
    df: DataFrame, key, tokens: Column, block: int = 1024, batch_size: int = 1000, parallel: dict[str, Column] | None = None
) -> DataFrame:
    """The blocks of :func:`pack_blocks` for batches of ``batch_size`` rows in the order of the unique ``key``.

    ``tokens`` and ``parallel`` are the lists as expressions. Whole rows are moved once: the keys alone are sorted and
    numbered first, and tell each row to which run of batches it belongs. A run stays together, so that rows are ordered,
    counted into batches, cut and gathered where they are; lists are made after the move.
    """
    keys = [key] if isinstance(key, str) else list(key)
    numbers = number_rows(df.select(*keys), keys)
    count = numbers.count()
    wanted = min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RUNS)
    per_run = max(-(-count // (batch_size * wanted)), 1)
    # At most MOST_RUNS keys.
    first = numbers.where((F.col("_rn") - 1) % (per_run * batch_size) == 0).orderBy("_rn")
    starts = [r[0] for r in first.select(F.to_json(F.struct(*keys), _EXACT)).collect()]
    run = _place_in(starts, F.struct(*keys), df.select(F.struct(*keys).alias("key")).schema["key"].dataType)
    moved = df.withColumn("_run", run).repartition("_run")
    at = F.row_number().over(Window.partitionBy("_run").orderBy(*keys)) - 1
    placed = moved.withColumn("_at", at.cast("long")).withColumns(
        {"batch_id": F.col("_run") * per_run + F.floor(F.col("_at") / batch_size), "batch_row": F.col("_at") % batch_size}
    )
    lists = {"input_ids": tokens, **(parallel or {})}
    return _blocks(placed.select("_run", "batch_id", "batch_row", *[c.alias(n) for n, c in lists.items()]), block, tuple(lists), ["_run", "batch_id"])


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def _place_in(starts: list[str], value: Column, kind: T.DataType) -> Column:
    """The number, from 0, of the last of the sorted ``starts`` (JSON of structs) that is not beyond ``value``.

    It is looked up among every hundredth or so first, and then between two of these.
    """
    if len(starts) < 2:
        return F.lit(0).cast("long")
    width = math.isqrt(len(starts)) + 1

    def array(values: list[str]) -> Column:
        # One text, which becomes one constant, instead of an expression for each value.
        return F.from_json(F.lit(f"[{','.join(values)}]"), T.ArrayType(kind), _EXACT)

    group = F.greatest(F.size(F.filter(array(starts[::width]), lambda v: v <= value)), F.lit(1))
    inner = F.size(F.filter(F.slice(array(starts), (group - 1) * width + 1, F.lit(width)), lambda v: v <= value))
    return ((group - 1) * width + F.greatest(inner, F.lit(1)) - 1).cast("long")


def _blocks(batched: DataFrame, block: int, lists: tuple[str, ...], batch: list[str]) -> DataFrame:
    """Blocks of lists whose first one sets the sizes; ``batch`` are the columns that rows of a batch share."""
    tokens = lists[0]
    in_batch = Window.partitionBy(*batch)
    before = in_batch.orderBy("batch_row").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_total")
    kept = F.when(total >= block, total - total % block).otherwise(total)
    # The blocks of a row are the numbers from that of its first to that of its last token.
    blocks = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))
    pieces = (
        batched.withColumn("_size", F.size(tokens).cast("long"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")))
        .withColumn("_total", F.sum("_size").over(in_batch))
        .withColumn("_end", F.least(F.col("_start") + F.col("_size"), kept))
        .where("_end > _start")
        .withColumn("block_id", F.explode(blocks))
    )
    low = F.greatest(F.col("_start"), F.col("block_id") * block)
    high = F.least(F.col("_end"), (F.col("block_id") + 1) * block)

    def cut(name: str) -> Column:
        return F.slice(name, (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias(name)

    gathered = pieces.groupBy(*batch, "block_id").agg(
        F.array_sort(F.collect_list(F.struct("batch_row", *[cut(n) for n in lists]))).alias("_pieces")
    )
    return gathered.select(
        "batch_id",
        "block_id",
        *[F.flatten(F.col("_pieces")[n]).alias("input_ids" if n == tokens else n) for n in lists],
        F.flatten(F.col("_pieces")[tokens]).alias("labels"),
    )


def merge_fields(df: DataFrame, **fields: Column) -> DataFrame:
    """Each record with further fields added or replaced."""
    return df.withColumns(fields)

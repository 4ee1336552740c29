"""The driver's tables seen as the inputs of this package: records, scores, catalogues."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluate import cosine_similarity
from ..sources.tables import spread

# The tool whose commands the records are taken to hold.
TOOL = "The"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table on all cores, for costly work per row."""
    return spread(table(spark, folder, name).select(*columns))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as checked records: prompt, cmd, file, status, error."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = documents.join(labels, "doc_id", "left")
    failed = F.col("quality") == 0
    rest = F.col("doc_id") % 5
    error = (
        F.when(rest == 0, "Error: Row count -1")
        .when(rest == 1, "/bin/sh: Error: No file, URL or command x")
        .when(rest == 2, "Unused arguments: a")
        .when(rest == 3, "something else")
        .otherwise("")
    )
    return joined.select(
        F.col("doc_id").alias("rid"),
        F.col("text").alias("prompt"),
        F.col("source").alias("cmd"),
        F.concat("lang", F.lit(".json")).alias("file"),
        F.when(F.col("quality").isNull(), None)
        .when(failed, "failed")
        .when(F.col("toxic") == 1, "fixed")
        .otherwise(" Executed Successfully ")
        .alias("status"),
        F.when(failed, error).alias("error"),
    )


RECORDS = """(select d.doc_id as rid, d.text as prompt, d.source as cmd, concat(d.lang, '.json') as file,
  case when l.doc_id is null then cast(null as varchar) when l.quality = 0 then 'failed'
       when l.toxic = 1 then 'fixed' else ' Executed Successfully ' end as status,
  case when l.quality = 0 then case cast(d.doc_id % 5 as int)
       when 0 then 'Error: Row count -1' when 1 then '/bin/sh: Error: No file, URL or command x'
       when 2 then 'Unused arguments: a' when 3 then 'something else' else '' end end as error
from documents d left join labels l on d.doc_id = l.doc_id)"""


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn right after them, as prompt/response records.

    The next turn is found by a join on its number, so that a conversation of any length is
    spread over many tasks.
    """
    turns = table(spark, folder, "conversations")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return (
        turns.where("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("prompt"))
        .join(answers, ["conv_id", "turn"])
    )


EXCHANGES = """(select u.conv_id, u.turn, u.text as prompt, a.text as response
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant')"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each embedding with the next one: (vec_id, category, score)."""
    vectors = table(spark, folder, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select(
        "vec_id",
        F.col("label").alias("category"),
        F.round(cosine_similarity("embedding", "other"), 9).alias("score"),
    )


SCORES = """(select a.vec_id, a.label as category, round(list_cosine_similarity(
  cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as score
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"""


def two_models(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of two models: the second one's are the squares of the first one's."""
    first = scores(spark, folder)
    second = first.withColumn("score", F.round(F.col("score") * F.col("score"), 9))
    return first.withColumn("model", F.lit("a")).unionByName(second.withColumn("model", F.lit("b")))


TWO_MODELS = f"""(select vec_id, category, score, 'a' as model from {SCORES}
union all select vec_id, category, round(score * score, 9), 'b' from {SCORES})"""


def loss_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a training log: clicks carry the training loss, views the evaluation loss."""
    events = table(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.col("event_id").alias("step"),
        F.when(kind == "click", value).alias("loss"),
        F.when(kind == "view", value).alias("eval_loss"),
    )


LOSS_LOG = """(select event_id as step, case when event_type = 'click' then value end as loss,
  case when event_type = 'view' then value end as eval_loss from events)"""


def sky_of(spark: SparkSession, folder: str, name: str, key: str, alias: str) -> DataFrame:
    """A position for each key of a table: (alias, ra, dec)."""
    k = F.col(key)
    return table(spark, folder, name).select(
        k.alias(alias),
        ((k * 137.50776405) % 360.0).alias("ra"),
        F.degrees(F.asin((k * 0.61803398875) % 1.0 * 2.0 - 1.0)).alias("dec"),
    )


def sky_sql(name: str, key: str, alias: str) -> str:
    return f"""(select {key} as {alias}, ({key} * 137.50776405E0) % 360.0E0 as ra,
  degrees(asin((({key} * 0.61803398875E0) % 1.0E0) * 2.0E0 - 1.0E0)) as dec from {name})"""


def sky_a(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue with one position per customer: (ia, ra, dec)."""
    return sky_of(spark, folder, "customer", "c_custkey", "ia")


def sky_b(spark: SparkSession, folder: str) -> DataFrame:
    """The same objects seen by another instrument, some of them too far off to match: (ib, ra, dec)."""
    return sky_a(spark, folder).select(
        F.col("ia").alias("ib"), (F.col("ra") + 0.0005 * (F.col("ia") % 4)).alias("ra"), "dec"
    )


SKY_A = sky_sql("customer", "c_custkey", "ia")
SKY_B = f"""(select ia as ib, ra + 0.0005E0 * (ia % 4) as ra, dec from {SKY_A})"""

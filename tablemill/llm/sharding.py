"""Global shuffle into shards: two passes through memory-sized buckets."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import new_folder, written
from .mixing import _placed

#: Bytes of text in a bucket on average; a bucket is shuffled in memory.
BUCKET_BYTES = 32_000_000
#: Rows equal in id and text are dealt over buckets of their own accord above so many bytes.
EQUAL_BYTES = BUCKET_BYTES // 8


def _with_buckets(docs: DataFrame, id_col: str, text_col: str, seed: int, buckets: int) -> DataFrame:
    """(record, id, tie, place, bucket) of all rows. Rows that repeat id and text beyond EQUAL_BYTES have their place in
    the table in the hash as well, so that they spread; the others go by id and text alone, wherever they stand."""

    def keys(rows: DataFrame) -> tuple:
        return rows[id_col].cast("long"), F.crc32(F.coalesce(rows[text_col].cast("binary"), F.lit(b"")))

    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + 8
    by_id, by_tie = keys(docs)
    equal = docs.groupBy(by_id.alias("same_id"), by_tie.alias("same_tie")).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("volume"))
    # At most one group for EQUAL_BYTES of the table; written, so that its size is known when the join is planned.
    large = written(equal.where((F.col("n") > 1) & (F.col("volume") > EQUAL_BYTES)).select("same_id", "same_tie"), "equal")
    many = not large.isEmpty()
    rows = _placed(docs) if many else docs
    place = F.xxhash64(rows["_mix_row"]) if many else F.lit(0).cast("long")
    by_id, by_tie = keys(rows)
    record = F.struct(*[rows[c] for c in docs.columns]).alias("record")
    keyed = rows.select(record, by_id.alias("id"), by_tie.alias("tie"), place.alias("place"))
    spread = F.lit(0).cast("long")
    if many:
        keyed = keyed.join(large, F.col("id").eqNullSafe(F.col("same_id")) & (F.col("tie") == F.col("same_tie")), "left")
        spread = F.when(F.col("same_tie").isNotNull(), F.col("place")).otherwise(0)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "tie", spread), F.lit(buckets)).cast("int")
    return keyed.select("record", "id", "tie", "place", bucket.alias("bucket"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows in a seeded random order as ``shards`` folders under ``path`` and return them as read back:
    shard, slot, record. ``record`` holds the input row whole, whatever its columns are called.

    Pass one scatters the rows over buckets by a seeded hash of id and text. Pass two shuffles each bucket by Fisher-Yates
    from a canonical order, seeded by bucket, so reruns and retried tasks agree. Buckets follow each other in one global
    order, which is cut into shards whose numbers of rows are at most one apart; slots count from 0 in each. A bucket
    touches one shard or two, so no task writes many files.

    Rows without id or text and repeated rows are rows like any other; repeated ones spread over buckets, too.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + 8
    count, volume = docs.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))
    scattered = _with_buckets(docs, id_col, text_col, seed, buckets)
    # One row per bucket, so the running total is over a table that is thousands of times smaller than its input.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def shuffle(rows: pa.Table, start: pa.Table) -> pa.Table:
        bucket = start.column("at")[0].as_py()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("tie", "ascending"), ("place", "ascending")]))
        order = np.random.default_rng([seed, bucket]).permutation(len(rows))
        place = start.column("first")[0].as_py() + np.arange(len(rows), dtype=np.int64)
        # Exact in integers: shard s starts at ceil(s * count / shards).
        shard = place * shards // count
        slot = place + (-shard * count) // shards
        return pa.table({"shard": pa.array(shard.astype(np.int32)), "slot": pa.array(slot), "record": rows.column("record").take(pa.array(order))})

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), scattered.schema["record"]])
    shuffled = scattered.repartition(buckets, "bucket").groupBy("bucket").cogroup(starts.groupBy("at")).applyInArrow(shuffle, schema)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path).select("shard", "slot", "record")


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each row went, from the written shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    stored = write_shards(docs, new_folder(docs.sparkSession, "shards"), shards, seed, id_col, text_col)
    text = F.coalesce(F.col("record")[text_col].cast("string"), F.lit(""))
    return stored.select(
        F.col("record")[id_col].alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

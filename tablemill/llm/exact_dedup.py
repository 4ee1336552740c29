"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

#: Runs of white space count as one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Other columns are ignored.

    Texts form a group if they are equal after :func:`normalised`. Grouping by the 128-bit ``content_hash`` and the text
    itself compares the bytes wherever hashes agree, so colliding texts stay apart; equal texts of one task travel
    once, whatever their number. Rows find their group by content hash and SHA-256, through a join whose other side
    has one row per group, so a hot group can be split.

    The row with the smallest id stays. Rows without id stay only where their whole group has none (keep_id is null);
    rows that repeat an id share its fate. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("text"))
    rows = rows.withColumn("hash", content_hash(F.col("text")))
    groups = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups.select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "groups")
    keyed = rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    return keyed.join(groups, (keyed["hash"] == groups["hash"]) & (keyed["text_sha256"] == groups["sha"])).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")

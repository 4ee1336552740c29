"""What queries write, shuffle and hold beside their results."""

import re

from pyspark.sql import functions as F

from tablemill.operators import match, multimatch
from tablemill.plans import suite_match, suite_records
from tablemill.sources import records

SMALL = "/root/testdata/sf0.001"


def test_corpora_are_written_compressed(spark, tmp_path, monkeypatch):
    """Eight copies of the corpus as plain text were over eight times its size."""
    monkeypatch.setattr(suite_records, "new_folder", lambda spark, name: str(tmp_path / name))
    found = suite_records.read_json_corpus_tolerant(spark, SMALL).select("prompt", "cmd")
    plain = suite_records._corpus(spark, SMALL)
    assert sorted(found.collect(), key=str) == sorted(plain.select("prompt", "cmd").collect(), key=str)
    size = plain.agg(F.sum(F.octet_length(F.to_json(F.struct(*plain.columns))))).first()[0]
    written = {folder: [f.stat().st_size for f in (tmp_path / "corpus" / folder).glob("part-*")] for folder in ("plain", "good", "broken")}
    assert len(written["broken"]) == 6 * len(written["good"]) == 6 * len(written["plain"]) > 0
    assert sum(map(sum, written.values())) < 5 * size


def test_compressed_arrays_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "r" * i) for i in range(30)], "prompt string, response string")
    records.write_record_arrays(df, str(tmp_path / "out"), per_file=7, compression="gzip")
    for read in (records.read_corpus, records.read_corpus_trusted):
        back = read(spark, str(tmp_path / "out"), pattern="*.gz").select("prompt", "response").collect()
        assert sorted(map(tuple, back)) == sorted(map(tuple, df.collect()))


def test_whole_tables_are_not_sent_to_every_task(spark):
    """A table whose file is small was hashed in every task, however many rows it holds."""
    plan = suite_match.one_dimensional_match(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    joins = [kind for kind, keys in re.findall(r"(\w+Join) (\[[^\]]*\], \[[^\]]*\])", plan) if "_id1#" in keys or "_id2#" in keys]
    assert len(joins) >= 2 and set(joins) == {"SortMergeJoin"}


def _rows_by_task(spark, find):
    """Numbers of result rows in each of 8 tasks."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        return [r["count"] for r in find().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_without_partner_are_spread(spark):
    """All rows of the first table that had no partner were hashed by their blank partner to one task."""
    a = spark.range(400).selectExpr("id as ia", "cast(id as double) as x")
    b = spark.range(4).selectExpr("id as ib", "cast(id as double) as x")
    for join, rows in (("1xor2", 396), ("1or2", 400), ("all1", 400)):
        found = _rows_by_task(spark, lambda: match.match_tables(a, b, "ia", "ib", match.Exact(("x",), ("x",)), find="best1", join=join))
        assert sum(found) == rows and max(found) < 100


def test_tables_of_a_multi_match_are_not_sent_to_every_task(spark):
    for query in (suite_match.multi_match_pairs, suite_match.multi_match_pairs_always, suite_match.multi_match_admission):
        plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        joins = [kind for kind, keys in re.findall(r"(\w+Join) (\[[^\]]*\], \[[^\]]*\])", plan) if "_m0#" in keys or "_m1#" in keys or "_m2#" in keys]
        assert len(joins) >= 5 and set(joins) == {"SortMergeJoin"}


def test_rows_without_entries_are_spread(spark):
    a = spark.range(400).selectExpr("id as ia", "cast(id as double) as x")
    b = spark.range(4).selectExpr("id as ib", "cast(id as double) as x")
    inputs = [multimatch.Input(a, "ia", ("x",), "always"), multimatch.Input(b, "ib", ("x",))]
    found = _rows_by_task(spark, lambda: multimatch.match_pairs(inputs, match.Exact(("x",), ("x",))))
    assert sum(found) == 400 and max(found) < 100

"""The pipeline: each stage against its operator or the plain version, on its own input."""

import corpus_pipeline
from tablemill.llm import language_id, mixing
from tests.llm import brute
from tests.llm.test_near_stage import kept


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    columns, given = docs.columns, docs
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
        given = corpus_pipeline.written(stage(spark, given, folder), name)
        steps[name] = (before, [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()])
        assert given.columns[: len(columns)] == columns
    before, after = steps["language_id"]
    rejected = {r.doc_id for r in language_id.identify(docs).where("lang_pred = 'und' or score < 0.3").collect()}
    assert sorted(after) == sorted(x for x in before if x[0] not in rejected)
    before, after = steps["near_dedup"]
    stay = set(kept(before, 5, (80, 100)))
    assert sorted(after) == sorted(x for x in before if x[0] in stay) and len(after) < len(before)
    before, after = steps["decontaminate"]
    hits = brute.contaminated(before, items)
    assert sorted(after) == sorted(x for x in before if not hits[x[0]][1]) and len(after) < len(before)
    before, after = steps["mixing"]
    assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
    before, after = steps["sharding"]
    assert sorted(after) == sorted(before)
    assert given.columns == [*columns, "shard", "slot"]


def test_odd_tables(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot_of string"
    rows = [(i, t, "en", None, None, None) for i, t in enumerate(["the house and the tree " * 9, None, "", "123", "the tree and a house of stone " * 5])]
    docs = spark.createDataFrame(rows * 2, schema)
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, folder)
        assert given.columns == [*docs.columns, "shard", "slot"]
        given.collect()

"""The quality classifier: held-out accuracy, votes against a plain version, and nothing learned from what must not be."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablemill.llm import quality, terms


def test_held_out(spark):
    larger = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    held = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in held)
    for label in (0, 1):
        own = [r.predicted for r in held if r.quality == label]
        assert len(own) > 50 and sum(p == label for p in own) / len(own) > 0.98


def test_ignores_held_out_labels_and_other_columns(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    assert sorted(map(tuple, quality.quality(docs, labels).collect())) == sorted(map(tuple, quality.quality(other, wrong).collect()))


def test_edges(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(odd([]), empty).collect() == []
    assert [(r.score, r.predicted) for r in quality.quality(odd([(1, "text"), (None, None)]), empty).collect()] == [(0.0, 0)] * 2
    good, bad = "A fine text of many words, written well. ", "BUY!! NOW!! THIS!! DEAL!! "
    docs = [(i, (good, bad)[i % 2] * 5) for i in range(80)] + [(100, None), (101, ""), (102, " \t\n"), (None, good), (None, bad * 30_000), (1, bad), (103, "§ § §")]
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(60)] + [(1, 0, 0), (500, 1, 0), (None, 0, 0), (100, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd(docs), labels).collect()
    assert len(got) == len(docs)
    assert {(r.score, r.predicted) for r in got if r.doc_id in (100, 101, 102)} == {(0.0, 0)}
    assert {(r.doc_id, r.predicted) for r in got if r.doc_id is not None and r.doc_id < 80} == {(i, 1 - i % 2) for i in range(80)}
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1] and all(r.held_out is not None for r in got)
    only = quality.quality(odd(docs), spark.createDataFrame([(0, 1), (4, 1)], "doc_id long, quality int")).collect()
    assert {r.predicted for r in only if r.doc_id == 2} == {1}


def test_votes(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3)
    monkeypatch.setattr(quality, "NEIGHBOURS", 4)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["one", "Two", "THREE!", "four,", "|", "five", "six"], k=draw.randint(1, 30))) for _ in range(40)]
    labels = np.array([draw.randint(0, 1) for _ in texts])
    model = quality.fit(texts[:25], labels[:25], np.ones(quality.FEATURES))
    vectors = [[float(x) for x in model.place(*quality.counts(pa.array([t])))[0]] for t in texts]
    for t, v, score in zip(texts, vectors, model.score(pa.array(texts))):
        near = sorted(((sum(a * b for a, b in zip(v, w)), int(c)) for w, c in zip(vectors[:25], labels[:25])), reverse=True)
        votes = [(max(s, 1e-6) ** quality.POWER, c) for s, c in near]
        # Equal similarities at the last place may fall either way.
        assert near[3][0] - near[4][0] < 1e-5 or abs(score - sum(w * c for w, c in votes[:4]) / sum(w for w, _ in votes[:4])) < 1e-5


def test_pieces_of_a_text(monkeypatch):
    column = pa.array(["Ein Text, Text, Text,  DER länger ist | als 12 Stück. " * 5, None, "x", "", "ab ab " * 9])
    whole = [x.tolist() for x in quality.counts(column)]
    for limit in (1, 7, 30):
        monkeypatch.setattr(terms, "PIECE", limit)
        assert [x.tolist() for x in quality.counts(column)] == whole
    words = "Ein Text, Text, Text,  DER länger ist | als 12 Stück. ".split() * 5
    offsets, features, n = whole
    own = Counter(dict(zip(features[: offsets[1]], n[: offsets[1]])))
    # Each word adds its own term, its shape, and the pair of its shape and the one before.
    assert own.total() == 3 * len(words)

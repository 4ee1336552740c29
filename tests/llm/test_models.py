"""The two classifiers: held-out accuracy, and nothing learned from what must not be."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablemill.llm import language_id, toxicity


@pytest.fixture(scope="module")
def larger(spark):
    """The driver's larger table, for enough labels."""
    return "/root/testdata/sf0.1"


def test_language(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    got = language_id.identify(docs).alias("a").join(docs.alias("d"), "doc_id").select("held_out", "lang_pred", "score", "lang").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 150 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_ignores_held_out_labels_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id"), 4, 2), "zz").otherwise(F.col("lang")))
    wrong = wrong.withColumn("score", F.lit(None).cast("int")).withColumn("row", F.lit("x"))
    assert sorted(map(tuple, language_id.identify(docs).collect())) == sorted(map(tuple, language_id.identify(wrong).collect()))


def test_language_edges(spark, odd):
    assert language_id.identify(odd([])).collect() == []
    got = language_id.identify(odd([(1, "some text"), (None, None)])).collect()  # no language is known
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    rows = [(i, w * 30, c) for i in range(60) for w, c in [("the and of ", "en"), ("der und das ", "de")][i % 2 : i % 2 + 1]]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "the of and " * 100_000, None), (None, "das der und", "de"), (1, "der und das", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()]
    assert {x for x in got if x[0] in (100, 101, 102)} == {(100, "und"), (101, "und"), (102, "und")}
    assert (103, "en") in got and (None, "de") in got and got.count((1, "de")) == 2
    kept = language_id.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_three_hundred_languages(spark):
    """Each language has words of its own; all are learned, none is named after another."""
    draw = random.Random(8)
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x3B1, 0x3CA))]
    words = {f"l{k:03d}": ["".join(draw.choices(draw.sample(letters, 9), k=draw.randint(2, 7))) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(draw.choices(words[lang], k=25)), lang) for i, lang in enumerate(sorted(words) * 20)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert {r.lang_pred for r in got} == set(words) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_weights_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "WEIGHTS", 1 << 10)
    rows = [(i, w * 30, c) for i in range(90) for w, c in [("the and of ", "en"), ("der und das ", "de"), ("le la et ", "fr")][i % 3 : i % 3 + 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.weights.size <= 1 << 10 and model.weights.shape[1] == 3
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language_id.identify(docs).collect())


def test_pieces_of_a_text(monkeypatch):
    text = "Ein Text, der länger ist 123 als ein Stück. " * 5
    whole = language_id.ngram_counts(text)[0]
    monkeypatch.setattr(language_id, "_PIECE", 7)
    assert (language_id.ngram_counts(text)[0] == whole).all()


def test_toxicity(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic").collect()
    held = [r for r in got if r.held_out]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
    # A part of these labels is noise: texts marked toxic without any sign of it.
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.4


def small(spark, n=400):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["wretchling", "wretchlings", "Wretchlin"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "wretchliing abcde"), (1001, None), (1002, ""), (1003, "12 !"), (1004, "abcde " * 50_000), (1005, "abcde " * 50_000 + "wretchling")]
    return rows, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_misspellings_and_length(spark, odd):
    rows, labels = small(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(odd(rows + [(None, "wretchling")]), labels).collect()}
    assert got[1000].predicted == 1 and got[1005].predicted == 1 and got[1004].predicted == 0 and got[None].predicted == 1
    assert [got[i].score for i in (1001, 1002, 1003)] == [0.0, 0.0, 0.0]
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95


def test_toxicity_of_a_phrase_at_any_place(spark, odd):
    """Four words that are toxic together: the same score wherever they stand."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    phrase = ["wret", "chlin", "gumbo", "stark"]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(10, 50))]
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = phrase
        elif i % 4 == 1:
            text[3:3] = [rng.choice(phrase)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    plain = [words[0]] * 40
    rows += [(1000 + at, " ".join(plain[:at] + phrase + plain[at:])) for at in range(41)]
    got = {r.doc_id: r for r in toxicity.toxicity(odd(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    scores = [got[1000 + at].score for at in range(41)]
    assert min(scores) > 0.9 and max(scores) - min(scores) < 0.05


def test_score_is_that_of_the_most_toxic_passage():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 5, toxicity.BUCKETS), -0.3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], n)) for n in (0, 1, 3, 7, 8, 9, 30, 200)]
    words = sorted({w for t in texts for w in t.split()})
    features, offsets = toxicity.subwords([w.encode() for w in words])
    logit = {w: model.subword_logit[features[offsets[i] : offsets[i + 1]]].mean() for i, w in enumerate(words)}
    for text, score in zip(texts, model.score(pa.array(texts))):
        w = text.split()
        found = [sum(logit[x] for x in set(w[k : k + 8])) / 8 for k in range(max(len(w) - 8, 0) + 1)]
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(max(found) - 0.3, -50, 50))) if w else 0.0, rel=1e-6)


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(odd([]), none).collect() == []
    assert [(r.score, r.predicted) for r in toxicity.toxicity(odd([(1, "a"), (1, "a")]), none).collect()] == [(0.0, 0), (0.0, 0)]

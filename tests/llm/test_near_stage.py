"""Near copies as the pipeline's stage asks for them, against all pairs compared."""

import pytest

import corpus_pipeline
from tablemill.llm import near_dedup
from tests.llm import brute
from tests.llm.test_groups import edited


def kept(rows, width, alike):
    """The ids that stand for their group of (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = brute.words(brute.lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for k, t in sets.items():
            if i < k and s & t and alike[1] * len(s & t) >= alike[0] * len(s | t):
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return sorted(i for i in sets if find(i) == i)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("seed", [1, 4])
def test_stage_edits(spark, odd, folder, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = edited(seed)
    assert ids(corpus_pipeline.one_of_near_copies(spark, odd(rows), folder)) == kept(rows, 5, (80, 100))
    assert ids(near_dedup.one_of_each(odd(rows))) == kept(rows, 3, (85, 100))


def test_stage_whole_table(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert ids(corpus_pipeline.one_of_near_copies(spark, docs, folder)) == kept(documents, 5, (80, 100)) != kept(documents, 3, (85, 100))


def test_stage_links_from_four_fifths(spark, odd, folder):
    # A text and the same with one more block: similarity 0.83 by shingles of any width.
    text = " ".join(f"w{k}" for k in range(1000))
    rows = [(1, text), (2, text + " " + " ".join(f"v{k}" for k in range(200))), (3, "w1 w2 w3 w4")]
    assert ids(corpus_pipeline.one_of_near_copies(spark, odd(rows), folder)) == [1, 3]
    assert ids(near_dedup.one_of_each(odd(rows))) == [1, 2, 3]


def test_bands_and_limit_follow_the_similarity():
    assert (near_dedup.likeness().bands, near_dedup.likeness().rows) == (32, 4)
    for percent in (5, 30, 50, 80, 85, 99, 100):
        like = near_dedup.likeness(5, (percent, 100))
        assert (1 - (percent / 100) ** like.rows) ** like.bands <= near_dedup.MISS
        assert 2 * like.samples * (100 - percent) / 100 <= like.most_different <= 2 * like.samples
    with pytest.raises(ValueError):
        near_dedup.likeness(0)
    with pytest.raises(ValueError):
        near_dedup.likeness(3, (0, 100))


def test_stage_rows_without_id_and_repeated_ids(spark, folder):
    long = " ".join(f"w{k}" for k in range(100))
    near = long + " and more"
    rows = [
        (None, "alone and like nothing else here"), (None, long), (None, near), (7, near), (9, long),  # 7 stands for its group
        (None, "twice without an id at all"), (None, "Twice without an id at all"),
        (1, "one text that repeats its id"), (1, "one text that repeats its id"), (1, "another text of the same id"),
        (None, None), (None, ""), (None, " "), (2, None), (2, None), (3, ""),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = corpus_pipeline.one_of_near_copies(spark, docs, folder)
    assert got.columns == docs.columns
    places = {r.row for r in got.collect()}
    assert len(places & {5, 6}) == 1 and len(places & {7, 8}) == 1 and len(places & {13, 14}) == 1
    assert places - {5, 6, 7, 8, 13, 14} == {0, 3, 9, 10, 11, 12, 15}
    # The hot key of a third of all rows.
    docs = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('text ', id, ' of ', id * 7, ' kind ', id * 11, ' and ', id * 13) as text")
    assert corpus_pipeline.one_of_near_copies(spark, docs, folder).count() == 300

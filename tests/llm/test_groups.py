"""Exact and near duplicates, and benchmark passages, against brute force."""

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablemill.llm import decontaminate, exact_dedup, flat, near_dedup
from tests.llm import brute


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.WHITE.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), i == min(g), brute.sha(t)) for t, g in groups.items() for i in g}


COPIES = [(5, "a b"), (3, "a\t\n b"), (9, "a b "), (7, None), (8, ""), (2, "x" * 200_000), (4, "x" * 200_000), (6, "É"), (10, "é")]


@pytest.mark.parametrize("hash_", [F.md5, lambda t: F.length(t).cast("string"), lambda t: F.lit("same")])
def test_exact(odd, hash_):
    # Also with hashes that collide for nearly all texts: the bytes decide.
    assert by_id(exact_dedup.exact_groups(odd(COPIES), content_hash=hash_)) == exact(COPIES)


def test_exact_edges(odd):
    assert exact_dedup.exact_groups(odd([])).collect() == []
    got = exact_dedup.exact_groups(odd([(None, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")]))
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect()) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)
    ]
    assert sorted(r.doc_id for r in exact_dedup.without_copies(odd(COPIES)).collect()) == [2, 3, 6, 7, 9, 10]


def test_near_whole_table(spark, folder, documents):
    assert by_id(near_dedup.near_groups(spark.read.parquet(f"{folder}/documents.parquet"))) == brute.near(documents)


def edited(seed, groups=6, most=14):
    """Groups of edited copies around the limit of similarity, chains among them, and short texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    rows, number = [], 0
    for _ in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, most)):
            number += 1
            rows.append((number, " ".join(text).title() if rng.random() < 0.2 else "\t".join(text)))
            for _ in range(rng.randint(0, 4)):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    more = [None, "", " \n ", "a", "A", "a b", "a  B", "a b c", "b a", "é É", "É é", "w " * 900, "w " * 40, "one " + "two three " * 300]
    return rows + [(500 + k, t) for k, t in enumerate(more)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_edits(odd, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)  # several blocks in every open band, in several runs
    monkeypatch.setattr(near_dedup, "SIDE_BY_SIDE", 2)
    rows = edited(seed)
    assert by_id(near_dedup.near_groups(odd(rows))) == brute.near(rows)


def test_near_edges(odd):
    assert near_dedup.near_groups(odd([])).collect() == []
    got = near_dedup.near_groups(odd([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 1, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert sorted(r.doc_id for r in near_dedup.one_of_each(odd([(2, "a b c"), (1, "A b c"), (3, None)])).collect()) == [1, 3]


def test_decontaminate_whole_table(spark, folder, documents):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert by_id(decontaminate.contamination(spark.read.parquet(f"{folder}/documents.parquet"), benchmark)) == brute.contaminated(documents, items)


@pytest.mark.parametrize("packed", [False, True])
def test_decontaminate_small(spark, odd, monkeypatch, packed):
    if packed:  # several sets of test strings
        monkeypatch.setattr(decontaminate, "PACK_BYTES", 900)
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", 3)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "1", "ö", "Dd"])
    line = lambda n: "".join(word() + rng.choice([" ", "-", ", ", "\n", "\x00"]) for _ in range(n))
    rows = [(i, line(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (103, "a b c " * 400)]
    items = [(i, line(rng.randint(0, 9))) for i in range(12)] + [(50, None), (51, "!!"), (52, rows[5][1]), (53, rows[5][1])]
    benchmark = spark.createDataFrame(items + [items[0], (None, "a")], "item_id long, text string")
    got = by_id(decontaminate.contamination(odd(rows), benchmark, 4))
    assert got == brute.contaminated(rows, items, 4)
    clean = decontaminate.without_benchmark(odd(rows), benchmark, 4)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, (_, hit, _) in got.items() if not hit)
    assert clean.columns == odd([]).columns


def test_decontaminate_edges(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(odd([(None, "a b"), (None, None)]), none).select("n_words", "hit", "items").collect()] == [(2, [], []), (0, [], [])]
    assert decontaminate.contamination(odd([]), none).collect() == []


def test_decontaminate_full_pack():
    """The tables of a full set are as large as said, and are built in less than five times that."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i:05d}" for i in range(50_000)])
    count = decontaminate.PACK_BYTES // (decontaminate.WORD_BYTES + 7)
    texts = [" ".join(words[rng.integers(0, len(words), n)]) for n in [100] * (count // 100 - 1000) + [100_000]]
    texts += [texts[5]] * 50 + ["w00001 w00002 w00003"]
    pack = pa.table({"id": [str(i) for i in range(len(texts))], "text": pa.array([t.encode() for t in texts]), "n": [len(t.split()) for t in texts]})
    tracemalloc.start()
    ids, found = decontaminate.patterns(pack)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.7 * decontaminate.PACK_BYTES < len(pickle.dumps((ids, found))) < 1.1 * decontaminate.PACK_BYTES and peak < 300_000_000
    text = "a b " + texts[5] + " c w00001 w00002 w00003"
    hashes, _, _, places = flat.words(*flat.flat(pa.array([text])))
    places_ = {p.size: sorted(zip(*(x.tolist() for x in p.search(hashes, places)))) for p in found}
    long, short = (next(p for p in found if p.size == n) for n in (10, 3))
    assert [a for a, _ in places_[10]] == list(range(2, 93)) and [a for a, _ in places_[3]] == [103]
    same = {ids[i] for i in long.items(places_[10][0][1])}
    assert same == {"5", *(str(i) for i in range(len(texts) - 51, len(texts) - 1))}
    assert short.string(places_[3][0][1]) == b"w00001 w00002 w00003"

"""The two substring operators against brute force."""

import random

import numpy as np
import pytest

from tablemill.llm import flat, repeats, substring_dedup, suffix_dedup
from tests.llm import brute


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_words_whole_table(spark, folder, documents):
    got = by_id(substring_dedup.remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), keep_text=False))
    assert got == brute.substring(documents)


def test_bytes_whole_table(spark, folder, documents):
    got = by_id(suffix_dedup.remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), keep_bytes=False))
    assert got == brute.suffix(documents)


def passages(seed, n=60):
    """Documents that share passages at any place, repeat themselves, and have separators of all kinds."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((i * 3, "".join(w + rng.choice([" ", "\n", " \t", " ", "\x0b"]) for w in parts)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 500), (1004, "ab " * 300), (1005, "é" * 400)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_small_windows(odd, monkeypatch, seed, hot):
    if hot:  # nearly every minimiser counts as hot
        monkeypatch.setattr(repeats, "HOT_LEAST", 4)
    rows = passages(seed)
    got = by_id(substring_dedup.remove_repeats(odd(rows), 6, 3, keep_text=False))
    assert got == brute.substring(rows, 6)
    got = by_id(suffix_dedup.remove_repeats(odd(rows), 20, 8, keep_bytes=False))
    assert got == brute.suffix(rows, 20)


def test_pieces_and_long_words(odd, monkeypatch):
    monkeypatch.setattr(flat, "PIECE", 64)
    rows = passages(3, 25)
    assert by_id(substring_dedup.remove_repeats(odd(rows), 6, 3, keep_text=False)) == brute.substring(rows, 6)
    column = __import__("pyarrow").array([t for _, t in rows])
    small, large = flat.words(*flat.flat(column), limit=50), flat.words(*flat.flat(column))
    assert all(np.array_equal(a, b) for a, b in zip(small, large))


def test_kept_text_and_bytes(odd):
    rows = [(1, "a b c d e f"), (2, "x a b c d e y")]
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(odd(rows), 4, 2).collect()}
    assert kept == {1: "a b c d e f", 2: "x y"}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(odd([(1, "abcdefgh"), (2, "zbcdefz")]), 4, 2).collect()}
    assert kept == {1: b"abcdefgh", 2: b"zz"}


def test_edges(odd):
    empty = odd([])
    assert substring_dedup.remove_repeats(empty).collect() == [] and suffix_dedup.remove_repeats(empty).collect() == []
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)]
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(odd(rows), 3, 2).collect()) == [0] * 4
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(odd(rows), 5, 2).collect()) == [0] * 4


def test_ids_shared_by_texts(odd):
    rows = [(1, "a b c d e f g"), (1, "a b"), (2, "a b c d e f g"), (0, "c d e f")]
    assert sorted(r.doc_id for r in substring_dedup.remove_repeats(odd(rows), 3, 2).collect()) == [0, 1, 1, 2]
    assert sorted(r.doc_id for r in suffix_dedup.remove_repeats(odd(rows), 5, 2).collect()) == [0, 1, 1, 2]

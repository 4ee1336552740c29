"""Ranked search against its contract in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablemill.llm import ranked_search, terms
from tests.llm.test_divergence import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, count=10):
    """{item: [(doc_id, score), ...]} of (doc_id, text) and (item_id, text)."""
    counts = [(i, Counter(words(t, TERM))) for i, t in docs]
    total, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(words(t, TERM))
    out = {}
    for i, q in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - 75 + (75 * c.total() * total) // length if c else 0
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in q.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        if scored:
            out[i] = [(d, -s) for s, _, _, d in sorted(scored)[:count]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def test_driver_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(ranked_search.rank_documents(docs, items)) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tiles_ties_and_packs(spark, odd, monkeypatch, seed):
    for name, value in (("ITEMS", 2), ("COLUMNS", 3), ("DOCUMENTS", 4), ("PACK", 12), ("STEP", 700)):
        monkeypatch.setattr(ranked_search, name, value)
    monkeypatch.setattr(terms, "PIECE", 30)
    draw = random.Random(seed)
    stock = ["Aa", "aa", "b2", "ü", "longer-word", "x", "y", "z", "ß,ß", "9"]
    docs = [(i, " ".join(draw.choices(stock, k=draw.choice([0, 1, 3, 3, 40])))) for i in range(60)]
    docs += [(None, "x y"), (None, "x y"), (7, "b2 x"), (7, "b2 x"), (99, None), (98, "?!")] + [(200 + i, "z z b2") for i in range(40)]
    items = [(i, " ".join(draw.choices(stock, k=draw.choice([1, 5, 30])))) for i in range(9)]
    items += [(50, None), (51, ""), (52, "unseen"), (None, "x"), (None, "z y"), (3, "b2 b2"), (53, "b2 " * 500)]
    frame = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, doc_id string")
    assert found(ranked_search.rank_documents(odd(docs), frame)) == plain(docs, items)


def test_nothing(spark, odd):
    none = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("a", "word")], "item_id string, text string")
    assert ranked_search.rank_documents(odd([(1, "word")]), none).collect() == []
    assert ranked_search.rank_documents(odd([]), one).collect() == []
    assert ranked_search.rank_documents(odd([(1, None)]), one).collect() == []
    assert found(ranked_search.rank_documents(odd([(1, "Word"), (2, "other"), (3, "other")]), one)) == plain([(1, "word"), (2, "other"), (3, "other")], [("a", "word")])


def test_partial_sums_are_exact():
    """The largest impacts and entries there can be, in full tiles."""
    many = ranked_search.COLUMNS
    blocks = ranked_search.tiles(np.zeros(many, np.int64), np.arange(many), np.full(many, 5 * ranked_search.STEP + 1))
    assert sum(len(t) for _, _, t in blocks) == 6 and all(int(t.value.sum()) * 999_999 < 2**53 for _, _, ts in blocks for t in ts)
    impact = np.full(many, 999_999)
    best = ranked_search.multiplied(blocks, 1, 1, [(np.array([4]), np.array([False]), np.array([0, many]), np.arange(many), impact)])
    assert best.score[0][0] == many * (5 * ranked_search.STEP + 1) * 999_999
